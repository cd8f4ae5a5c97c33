"""Shift calendar, shift of an instant, and the split of an interval into slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.clock import second_of_day, time_to_seconds
from millwright.params import DEFAULTS

DAY = 86_400


def shift_calendar(shifts: DataFrame) -> DataFrame:
    """Active shifts of companies, with start and end as seconds of the day."""
    return shifts.where(F.col("is_active") & F.col("company_id").isNotNull()).select(
        F.col("id").alias("shift_id"), "company_id",
        time_to_seconds(F.col("start_time")).alias("start_s"),
        time_to_seconds(F.col("end_time")).alias("end_s"),
    )


def calendar_by_company(calendar: DataFrame) -> DataFrame:
    """One row per company with its handful of shifts as an array, lowest id first."""
    shift = F.struct("shift_id", "start_s", "end_s")
    return calendar.groupBy("company_id").agg(F.array_sort(F.collect_list(shift)).alias("shifts"))


def shift_at(shifts: Column, epoch_s: Column, offset: int = DEFAULTS.zone_offset_s) -> Column:
    """Lowest shift id covering the instant, both ends inclusive; null outside every shift."""
    t = second_of_day(epoch_s, offset)

    def covers(s):
        return F.when(s["start_s"] <= s["end_s"], (t >= s["start_s"]) & (t <= s["end_s"])).otherwise(
            (t >= s["start_s"]) | (t <= s["end_s"]))

    return F.get(F.filter(shifts, covers), F.lit(0))["shift_id"]


def with_shift_at(df: DataFrame, calendar: DataFrame, at: str, name: str = "shift_id") -> DataFrame:
    by_company = calendar_by_company(calendar)
    joined = df.join(by_company, "company_id", "left")
    return joined.withColumn(name, shift_at(F.col("shifts"), F.col(at))).drop("shifts")


def calendar_segments(calendar: DataFrame) -> DataFrame:
    """The local day of every company cut at the hours and at its shifts' starts and ends, each piece with its shift.

    Rows: company_id, hour (0 to 23), seg_from, seg_to (seconds of the day), shift_id; pieces outside every shift are left
    out. A cut itself is a row too (seg_from = seg_to): both ends of a shift belong to it, so an instant on a bound can have
    another shift than the pieces beside it. Some 30 rows a company.
    """
    hours = calendar.select("company_id").distinct().select("company_id", F.explode(F.sequence(F.lit(0), F.lit(DAY - 3600), F.lit(3600))).alias("cut"))
    bounds = calendar.select("company_id", F.explode(F.array(F.col("start_s").cast("int"), F.col("end_s").cast("int"))).alias("cut")).where(F.col("cut").between(0, DAY - 1))
    cuts = hours.unionByName(bounds).distinct()
    following = F.lead("cut", 1, DAY).over(Window.partitionBy("company_id").orderBy("cut"))
    pieces = cuts.select("company_id", F.col("cut").alias("seg_from"), following.alias("seg_to")).unionByName(
        cuts.select("company_id", F.col("cut").alias("seg_from"), F.col("cut").alias("seg_to")))
    t, a, b = (F.col("seg_from") + F.col("seg_to")) / 2, F.col("start_s"), F.col("end_s")
    covers = F.when(a <= b, (t >= a) & (t <= b)).otherwise((t >= a) | (t <= b))
    return (pieces.join(calendar, "company_id").where(covers).groupBy("company_id", "seg_from", "seg_to").agg(F.min("shift_id").alias("shift_id"))
            .withColumn("hour", F.expr("seg_from div 3600").cast("int")))


def split_interval(df: DataFrame, segments: DataFrame, start: str, end: str, offset: int = DEFAULTS.zone_offset_s) -> DataFrame:
    """One row per slice of [start, end) inside a shift: slice_from, seconds, shift_id, hour_start, is_last.

    An interval becomes one row for every local hour it touches, and meets the company's segments of that hour: a range
    join by equality, spread over company and hour. Slices outside every shift find no segment and are left out. An
    interval of no length is one slice of 0 seconds, its shift that of the instant.
    """
    a, b = F.col(start), F.col(end)
    local = lambda t: F.call_function("div", t + offset, F.lit(3600).cast("long"))
    hours = df.where(a <= b).withColumn("_h", F.explode(F.sequence(local(a), local(F.greatest(a, b - 1)))))
    dealt = hours.withColumn("hour", (F.col("_h") % 24).cast("int")).withColumn("_day", F.expr("_h div 24") * DAY - offset)
    from_at, to_at = F.col("_day") + F.col("seg_from"), F.col("_day") + F.col("seg_to")
    whole = F.col("seg_from") < F.col("seg_to")
    meets = F.when(a < b, whole & (from_at < b) & (to_at > a)).otherwise((~whole & (from_at == a)) | ((from_at < a) & (a < to_at)))
    placed = dealt.join(segments, ["company_id", "hour"]).where(meets)
    slice_from = F.greatest(a, from_at)
    return placed.select(*df.columns, slice_from.alias("slice_from"), (F.least(b, to_at) - slice_from).alias("seconds"),
                         (to_at >= b).alias("is_last"), "shift_id", (F.col("_h") * 3600 - offset).alias("hour_start"))
