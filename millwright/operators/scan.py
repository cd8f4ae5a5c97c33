"""Running values along a machine's readings, split so that no group is unbounded.

A plain window over ``partitionBy(machine)`` puts every reading of a machine
into one task. Here the arrival order is cut into chunks of ``width``
consecutive sequence numbers, so a window group holds at most ``width`` rows
however hot its key is. What a chunk needs from earlier chunks is one small row
per (key, chunk): a plain aggregate, partially combined before its shuffle. A
window over those rows alone (rows / width per key) gives each chunk its
carry, which is joined back and combined with the value found inside the chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.params import DEFAULTS


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    restart: Column | None = None


def last(value: Column) -> Running:
    """The nearest non-null value."""
    return Running("last", value)


def prev(value: Column) -> Running:
    """The value of the neighbouring row, null included."""
    return Running("prev", F.struct(value.alias("v")))


def top(value: Column) -> Running:
    return Running("top", value)


def total(value: Column) -> Running:
    return Running("total", value)


def peak(value: Column, restart: Column) -> Running:
    """The highest value since the last row where ``restart`` holds, that row included."""
    return Running("peak", value, F.coalesce(restart, F.lit(False)))


def _over(spec: Running, window) -> Column:
    if spec.kind == "top":
        return F.max(spec.value).over(window)
    if spec.kind == "total":
        return F.sum(spec.value).over(window)
    return F.last(spec.value, ignorenulls=True).over(window)


def _summary(spec: Running, order: str, forward: bool) -> Column:
    if spec.kind == "top":
        return F.max(spec.value)
    if spec.kind == "total":
        return F.sum(spec.value)
    nearest = F.max_by if forward else F.min_by
    return nearest(spec.value, F.when(spec.value.isNotNull(), F.col(order)))


def _combine(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind == "top":
        return F.greatest(local, carry)
    if spec.kind == "total":
        nothing = F.lit(0)
        return F.coalesce(local, nothing) + F.coalesce(carry, nothing)
    if spec.kind == "peak":
        same_run = F.coalesce(local["g"], F.lit(0)) == 0
        return F.when(same_run, F.greatest(local["p"], carry)).otherwise(local["p"])
    nearest = F.coalesce(local, carry)
    return nearest["v"] if spec.kind == "prev" else nearest


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "seq",
    before: dict[str, Running] | None = None,
    after: dict[str, Running] | None = None,
    width: int = DEFAULTS.chunk_seqs,
) -> DataFrame:
    """Add one column per entry: the running value strictly before / after the row.

    ``order`` is a unique non-negative whole number per key. ``after`` entries
    run the same scan from the far end (a descending sort, linear in the rows).
    """
    specs = [(n, s, True) for n, s in (before or {}).items()]
    specs += [(n, s, False) for n, s in (after or {}).items()]
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {int(width)}L"))

    def inside(forward: bool):
        way = F.col(order).asc() if forward else F.col(order).desc()
        return Window.partitionBy(*keys, "_chunk").orderBy(way).rowsBetween(Window.unboundedPreceding, -1)

    def across(forward: bool):
        way = F.col("_chunk").asc() if forward else F.col("_chunk").desc()
        return Window.partitionBy(*keys).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)

    # a peak restarts inside the chunk: number the restarts, then take the maximum of each run
    peaks = [(n, s) for n, s, _ in specs if s.kind == "peak"]
    upto = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for n, s in peaks:
        run = Window.partitionBy(*keys, "_chunk", f"_g_{n}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        chunked = (
            chunked.withColumn(f"_g_{n}", F.sum(s.restart.cast("long")).over(upto))
            .withColumn(f"_p_{n}", F.max(s.value).over(run))
        )
    resolved = [
        (n, Running("peak", F.struct(F.col(f"_g_{n}").alias("g"), F.col(f"_p_{n}").alias("p"))), fwd)
        if s.kind == "peak" else (n, s, fwd) for n, s, fwd in specs
    ]

    carries = chunked.groupBy(*keys, "_chunk").agg(
        *[_summary(s, order, fwd).alias(f"_s_{n}") for n, s, fwd in resolved]
    )
    chunks_upto = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    for n, _ in peaks:
        run = Window.partitionBy(*keys, f"_g_{n}").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
        carries = (
            carries.withColumn(f"_g_{n}", F.sum((F.col(f"_s_{n}.g") > 0).cast("long")).over(chunks_upto))
            .withColumn(f"_s_{n}", F.max(F.col(f"_s_{n}.p")).over(run))
        )
    carries = carries.select(
        *keys, "_chunk",
        *[_over(Running(s.kind, F.col(f"_s_{n}")), across(fwd)).alias(f"_c_{n}") for n, s, fwd in resolved],
    )
    local = chunked.select("*", *[_over(s, inside(fwd)).alias(f"_l_{n}") for n, s, fwd in resolved])
    joined = local.join(carries, [*keys, "_chunk"], "left")
    return joined.select(
        *df.columns,
        *[_combine(s, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s, _ in resolved],
    )
