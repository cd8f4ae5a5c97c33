"""Sharding by histogram sort, in DataFrame operations only.

Rows get a sort key; each round counts, over all partitions, the exact bytes below a set of candidate key
boundaries and refines only the intervals that still hold a splitter; when every splitter meets the tolerance the
rows are exchanged once, by the final intervals, and numbered.

Keys are strings of 48 hexadecimal digits: hash of the text, hash of the identifier, hash of the row's place. So equal
texts stand together, and a group of copies larger than the tolerance (or a row repeated without end) can still be cut.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.session import scratch_table

TEXT_DIGITS = 16  # of the key, those that equal texts share
KEY_DIGITS = 48


@dataclass(frozen=True)
class Leaf:
    """An interval of keys: those that begin with ``prefix``."""

    prefix: str
    rows: int
    size: int
    low: str
    high: str

    @property
    def deeper(self) -> int:
        """Digits of the next probes inside this interval; digits that all its keys share are skipped."""
        return min(KEY_DIGITS, len(os.path.commonprefix([self.low, self.high])) + 2)


def sort_key(id_col: str = "doc_id", text_col: str = "text"):
    """The key of a row, uniform over its range whatever the texts are."""
    parts = (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(F.col(id_col)), F.xxhash64(F.monotonically_increasing_id()))
    return F.concat(*(F.lpad(F.hex(p), 16, "0") for p in parts))


def _splitters(leaves: list[Leaf], shards: int, tolerance: float) -> tuple[list[int], set[int]]:
    """For each inner splitter the number of leaves below it, and the leaves that must be refined first."""
    below = [0]
    for leaf in leaves:
        below.append(below[-1] + leaf.size)
    total, cuts, refine = below[-1], [], set()
    slack = tolerance * total / shards / 2  # a shard has two splitters
    for j in range(1, shards):
        target = total * j / shards
        at = bisect_left(below, target)
        near = [i for i in range(max(0, at - 3), min(len(below), at + 3)) if abs(below[i] - target) <= slack]
        whole = [i for i in near if 0 < i < len(leaves) and leaves[i - 1].high[:TEXT_DIGITS] != leaves[i].low[:TEXT_DIGITS]]
        best = min(whole or near or (at - 1, at), key=lambda i: abs(below[i] - target))
        cuts.append(best)
        if not near and below[at] != target and leaves[at - 1].low != leaves[at - 1].high:
            refine.add(at - 1)
    return cuts, refine


def histogram_sort(rows: DataFrame, shards: int, tolerance: float = 0.01, leaf_rows: int = 1_000_000) -> DataFrame:
    """``rows`` (columns key, size and any others, read from a written table) with ``shard`` and ``slot``.

    The bytes of a shard differ from the mean by at most ``tolerance`` of it, or by part of one row if a single row is
    larger. A group of equal texts is cut only where no boundary between groups meets the tolerance. Slots count from 0
    without gaps in every shard, in key order. Only histograms reach the driver: at most 4,096 intervals and 256 more
    for each splitter or overfull interval. No window partition exceeds ``leaf_rows`` rows or 1/512 of all rows,
    whichever is less (128 at least).
    """
    spark = rows.sparkSession
    labelled, leaves, pending = rows.withColumn("node", F.expr("substring(key, 1, 3)")), {}, {}
    children = labelled
    while True:
        counted = children.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        for parent in pending:
            leaves.pop(parent, None)
        leaves |= {r.node: Leaf(r.node, r.n, r["size"], r.low, r.high) for r in counted.collect()}
        order = sorted(leaves.values(), key=lambda leaf: leaf.prefix)
        most = min(leaf_rows, max(128, sum(leaf.rows for leaf in order) // 512))
        cuts, refine = _splitters(order, shards, tolerance)
        chosen = [order[i] for i in refine] + [leaf for leaf in order if leaf.rows > most and leaf.low != leaf.high]
        pending = {leaf.prefix: leaf.deeper for leaf in chosen if len(leaf.prefix) < KEY_DIGITS}
        if not pending:
            break
        parents = spark.createDataFrame(list(pending.items()), "parent string, digits int")
        split = labelled.join(F.broadcast(parents), F.col("node") == F.col("parent"), "left").withColumn("node", F.expr("coalesce(substring(key, 1, digits), node)"))
        children, labelled = split.where("digits is not null"), split.drop("parent", "digits")
    placed, filled = [], [0] * shards
    for i, leaf in enumerate(order):
        shard = sum(cut <= i for cut in cuts)
        placed.append((leaf.prefix, shard, filled[shard]))
        filled[shard] += leaf.rows
    places = spark.createDataFrame(placed, "leaf string, shard int, below long")
    ordered = Window.partitionBy("node").orderBy("key")
    return (labelled.join(F.broadcast(places), F.col("node") == F.col("leaf")).withColumn("slot", F.col("below") + F.row_number().over(ordered) - 1)
            .drop("node", "leaf", "below"))


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text",
                    carry: list[str] | None = None) -> DataFrame:
    """All rows and columns (or those to ``carry``) of ``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot``.

    A null text has size 1 and stands with the empty ones. Repeated rows are kept and numbered apart. An empty table
    gives an empty result. Columns of the input named size, shard or slot are replaced; other columns pass through.
    The keyed rows are written once, so that every round counts the same keys even after an executor is lost.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    carried = [c for c in carry or docs.columns if c.lower() not in ("size", "shard", "slot")]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), sort_key(id_col, text_col).alias("key"), size.alias("size"))
    placed = histogram_sort(scratch_table(keyed, "shard-keys"), shards, tolerance)
    return placed.select("row.*", "size", "shard", "slot")
