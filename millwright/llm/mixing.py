"""Mixing sources to target weights, in DataFrame operations only.

Sizes (words) are summed per source; weights and a ceiling give each source a target, the target its repetition
rate. A document then stands in the mix floor(rate) times, and once more with a probability equal to the fraction,
drawn from a hash of its identifier, its text and its place among rows that are alike in both.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.session import scratch_table

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
DRAW_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in code point order, repeating
    ceiling: int = 3  # no target exceeds this many times its source's size
    seed: str = "mix"
    rank_rows: int = 100_000  # sources of one partition while they are numbered
    broadcast_sources: int = 20_000  # up to so many sources, their rates are sent to every task
    salts: int = 64  # beyond that, rows and rates meet by source and one of so many salts


DEFAULTS = MixParams()


def word_count(text: Column) -> Column:
    """Words of a text, without a list of them: every word becomes one letter, white space goes, letters are counted."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), WHITE, "")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame, p: MixParams) -> DataFrame:
    """Adds ``rank``, from 0, in code point order with null last; ranges are numbered apart and then added up."""
    ranges = max(1, math.ceil(sources.count() / p.rank_rows))
    dealt = sources.repartitionByRange(ranges, F.col("source").asc_nulls_last())
    fixed = scratch_table(dealt.withColumn("part", F.spark_partition_id()), "mix-sources")  # so that the ranges stay as they are
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    below = fixed.groupBy("part").agg(F.count("*").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return fixed.join(below, "part").withColumn("rank", F.col("below") + F.row_number().over(inside) - 1).drop("part", "below")


def source_targets(sources: DataFrame, p: MixParams = DEFAULTS) -> DataFrame:
    """Rows (source, source_size) with ``target``: shares of the whole by weight, none above ``ceiling`` sizes.

    What a source at its ceiling leaves over is shared again by weight among the others, until none is above. Every
    round compares whole numbers, so ties are exact; only two sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (F.col("rank") % len(p.weights) + 1).cast("int"))
    fixed = scratch_table(_numbered(sources, p).withColumn("weight", weight), "mix-weights")
    size, w = F.col("source_size"), F.col("weight")
    whole = fixed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    capped, held = F.lit(False), None
    while True:
        r = fixed.agg(F.coalesce(F.sum(F.when(~capped, w)), F.lit(0)).alias("weights"),
                      F.coalesce(F.sum(F.when(capped, size)), F.lit(0)).alias("capped"), F.count_if(capped).alias("n")).first()
        if held == r.n or not r.weights:
            break
        held, left = r.n, whole - p.ceiling * r.capped
        wide = lambda c: F.lit(c).cast("decimal(19,0)") if isinstance(c, int) else c.cast("decimal(19,0)")
        # a source at its ceiling stays there: the level only rises as others reach theirs
        capped = w.cast("decimal(10,0)") * wide(left) > (size * p.ceiling).cast("decimal(19,0)") * wide(r.weights)
    if not r.weights:
        return fixed.select("source", "source_size", (size * p.ceiling).cast("double").alias("target"))
    open_target = (w.cast("decimal(10,0)") * F.lit(whole - p.ceiling * r.capped).cast("decimal(19,0)")).cast("double") / F.lit(float(r.weights))
    return fixed.select("source", "source_size", F.when(capped, (size * p.ceiling).cast("double")).otherwise(open_target).alias("target"))


def _with_ordinals(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal``: the place, from 0, of a row among those with its key; 0 where the key stands alone.

    Rows carry ``cell``, the input partition they came from: a key's rows are counted by cell, so that no group grows
    beyond a cell however often a row is repeated.
    """
    by_cell = rows.groupBy("key", "cell").agg(F.count("*").alias("here"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    marks = (by_cell.withColumn("below", F.coalesce(F.sum("here").over(before), F.lit(0))).withColumn("all", F.sum("here").over(every))
             .where("all > 1").select(F.col("key").alias("k"), F.col("cell").alias("c"), "below"))
    marked = rows.join(marks, (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")), "left").drop("k", "c")
    alone = marked.where("below is null").withColumn("ordinal", F.lit(0).cast("long")).drop("below")
    inside = Window.partitionBy("key", "cell").orderBy("size")  # of one size all, so any order: rows of a key are alike
    again = marked.where("below is not null").withColumn("ordinal", F.col("below") + F.row_number().over(inside) - 1).drop("below")
    return alone.unionByName(again)


def _with_targets(rows: DataFrame, targets: DataFrame, p: MixParams) -> DataFrame:
    """Joins on the source, null included; beyond the checked size a source's rows are dealt over salts."""
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    if targets.count() <= p.broadcast_sources:
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    salted = named.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(p.salts)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))).drop("s", "t", "salt")


def mix_sources(docs: DataFrame, p: MixParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                carry: list[str] | None = None) -> DataFrame:
    """All rows and columns (or those to ``carry``) of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the document stands in the mix: floor(target / source_size), and one more with the
    fraction's probability. The draw depends on the seed, the identifier, the text and, for rows alike in both, their
    number among each other, so runs agree whatever the partitions are. A null text has size 0; a null source is a
    source of its own, the last. A source without words has target 0 and no copies. An empty table gives an empty
    result. Input columns of these names, and ``carry`` aside all others, keep their values except the four, which
    are replaced. A very long text is counted and hashed in place and never copied into a list of words.
    """
    own = ("size", "source_size", "target", "copies")
    carried = [c for c in carry or docs.columns if c.lower() not in own]
    key = F.concat_ws(":", F.lit(p.seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"), key.alias("key"), F.spark_partition_id().alias("cell"))
    rows = scratch_table(keyed, "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = _with_targets(_with_ordinals(rows), scratch_table(source_targets(sources, p), "mix-targets"), p)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "key", "ordinal")), 1, DRAW_DIGITS), 16, 10).cast("long").cast("double") / float(16 ** DRAW_DIGITS)
    copies = F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")
    return placed.select("row.*", "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its ``copies`` say, numbered by ``copy`` from 0."""
    wanted = mixed.where("copies > 0").drop("copy")
    return wanted.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
