"""Per-machine steps between readings and what they book: parts, energy, state time, gaps.

``production_steps`` runs one carried scan; everything after it is row-local.
Input readings: machine_id, company_id, seq, obs_at (device seconds),
machine_status, mode, parts_count (valid or null), energy (usable meter total
or null), and optionally standalone: a packet of the meter alone, which moves
the meter but neither clock nor state nor parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.status import is_manual, is_running
from millwright.operators.scan import last, peak, prev, scan
from millwright.operators.shifts import calendar_segments, split_interval
from millwright.params import DEFAULTS, Params


def parts_delta(baseline: Column, count: Column, gap_s: Column, p: Params = DEFAULTS) -> Column:
    """Parts to book for a count against the high-water baseline."""
    rise = count - baseline
    after_gap = gap_s >= p.gap_recovery_s
    ceiling = F.when(after_gap, p.max_delta_gap).otherwise(p.max_delta)
    return (
        F.when(baseline.isNull() | count.isNull(), F.lit(0))
        .when(rise < 0, F.when(count <= p.reset_at_most, count).otherwise(0))
        .when((rise >= p.stale_rise) & (baseline <= p.reset_at_most) & ~after_gap, 0)
        .when(rise > ceiling, 0)
        .otherwise(rise)
        .cast("long")
    )


def counter_after(baseline: Column, count: Column, p: Params = DEFAULTS) -> Column:
    """The baseline once the count is taken in: held on an unexplained fall."""
    return (
        F.when(count.isNull(), baseline)
        .when(baseline.isNull() | (count <= p.reset_at_most), count)
        .otherwise(F.greatest(baseline, count))
    )


def regressed(baseline: Column, count: Column, p: Params = DEFAULTS) -> Column:
    return F.coalesce((count < baseline) & (count > p.reset_at_most), F.lit(False))


def energy_delta(meter: Column, meter_at: Column, reading: Column, at: Column, p: Params = DEFAULTS) -> Column:
    """kWh since the last positive reading; null when there is nothing to compare."""
    step = reading - meter
    window_s = F.greatest(at - meter_at, F.lit(p.min_window_s))
    return (
        F.when(~F.coalesce(reading > 0, F.lit(False)) | meter.isNull(), F.lit(None).cast("double"))
        .when(step < 0, 0.0)
        .when(step > F.lit(p.max_kw) * window_s / 3600, 0.0)
        .otherwise(step)
    )


def is_counter_restart(count: Column, p: Params = DEFAULTS) -> Column:
    return count <= p.reset_at_most


def counter_steps(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds prev_at, gap_s, baseline_before, baseline, produced, regressed."""
    c = F.col("parts_count")
    s = scan(df, ["machine_id"], before={
        "prev_at": prev(F.col("obs_at")), "baseline_before": peak(c, is_counter_restart(c, p)),
    }, width=p.chunk_seqs)
    b, gap = F.col("baseline_before"), F.col("gap_s")
    return (
        s.withColumn("gap_s", F.coalesce(F.greatest(F.col("obs_at") - F.col("prev_at"), F.lit(0)), F.lit(0)).cast("long"))
        .withColumn("baseline", counter_after(b, c, p))
        .withColumn("produced", parts_delta(b, c, gap, p))
        .withColumn("regressed", regressed(b, c, p))
    )


def counter_uncertain(steps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Latch: set by a regression, cleared by a confirmed reset or a new high."""
    b, c = F.col("baseline_before"), F.col("parts_count")
    cleared = c.isNotNull() & (b.isNull() | (c <= p.reset_at_most) | (c > b))
    event = F.when(F.col("regressed"), True).when(cleared, False)
    s = scan(steps.withColumn("_event", event), ["machine_id"],
             before={"_latched": last(F.col("_event"))}, width=p.chunk_seqs)
    now = F.coalesce(F.col("_event"), F.col("_latched"), F.lit(False))
    return s.withColumn("uncertain", now).drop("_event", "_latched")


def energy_steps(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Adds meter_before, meter_before_at, energy_delta over the usable ``energy`` readings."""
    real = F.when(F.col("energy") > 0, F.struct(F.col("energy").alias("meter"), F.col("obs_at").alias("obs_at")))
    s = scan(df, ["machine_id"], before={"_meter": last(real)}, width=p.chunk_seqs)
    return (
        s.withColumn("meter_before", F.col("_meter.meter")).withColumn("meter_before_at", F.col("_meter.obs_at"))
        .withColumn("energy_delta", energy_delta(F.col("meter_before"), F.col("meter_before_at"),
                                                 F.col("energy"), F.col("obs_at"), p))
        .drop("_meter")
    )


def production_steps(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Counter, meter and previous-state columns of every reading, in one scan."""
    alone = F.coalesce("standalone", F.lit(False)) if "standalone" in df.columns else F.lit(False)
    c = F.when(~alone, F.col("parts_count"))
    real = F.when(F.col("energy") > 0, F.struct(F.col("energy").alias("meter"), F.col("obs_at").alias("obs_at")))
    s = scan(df, ["machine_id"], before={
        "_prev": last(F.when(~alone, F.struct("obs_at", "machine_status", "mode"))),
        "baseline_before": peak(c, is_counter_restart(c, p)),
        "_meter": last(real),
    }, width=p.chunk_seqs)
    carried = (
        s.withColumn("prev_at", F.when(~alone, F.col("_prev.obs_at")))
        .withColumn("prev_status", F.col("_prev.machine_status"))
        .withColumn("prev_mode", F.col("_prev.mode"))
        .withColumn("meter_before", F.col("_meter.meter")).withColumn("meter_before_at", F.col("_meter.obs_at"))
        .drop("_prev", "_meter")
    )
    return step_columns(carried, p).drop("meter_before", "meter_before_at")


def step_columns(carried: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """What a reading books, from its own columns and what the machine was like before it.

    Before it: prev_at (null for a packet of the meter alone), prev_status, prev_mode, baseline_before, meter_before,
    meter_before_at. Row-local, so batch and stream share it.
    """
    at = F.col("obs_at")
    alone = F.coalesce("standalone", F.lit(False)) if "standalone" in carried.columns else F.lit(False)
    c = F.when(~alone, F.col("parts_count"))
    b, gap = F.col("baseline_before"), F.col("gap_s")
    steps = (
        carried.withColumn("gap_s", F.coalesce(F.greatest(at - F.col("prev_at"), F.lit(0)), F.lit(0)).cast("long"))
        .withColumn("produced", parts_delta(b, c, gap, p))
        .withColumn("regressed", regressed(b, c, p))
        .withColumn("energy_delta", energy_delta(F.col("meter_before"), F.col("meter_before_at"), F.col("energy"), at, p))
        .withColumn("meter_from", F.coalesce(F.col("meter_before_at"), at))
    )
    used = F.coalesce(F.col("energy_delta") > 0, F.lit(False))
    return (
        steps.withColumn("long_gap", gap > p.freshness_s)
        .withColumn("long_meter_gap", used & (at - F.col("meter_from") > p.freshness_s))
    )


def gap_records(steps: DataFrame, p: Params = DEFAULTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per unobserved stretch, with what could not be given to an hour, and the columns to ``keep``."""
    used = F.coalesce(F.col("energy_delta") > 0, F.lit(False))
    start = F.when(F.col("long_gap"), F.least(
        F.col("prev_at"), F.when(used, F.col("meter_from")).otherwise(F.col("prev_at"))
    )).otherwise(F.col("meter_from"))
    return steps.where(F.col("long_gap") | F.col("long_meter_gap")).select(
        "seq", "company_id", "machine_id", start.alias("gap_from"), F.col("obs_at").alias("gap_to"),
        (F.col("obs_at") - start).alias("gap_seconds"),
        F.when(F.col("long_gap"), p.freshness_s).otherwise(0).cast("long").alias("known_state_seconds"),
        F.when(F.col("long_gap"), F.col("produced")).otherwise(0).cast("long").alias("unallocated_parts"),
        F.col("energy_delta").alias("unallocated_energy"),
        F.lit("observations_missing").alias("reason"), *keep,
    )


def state_intervals(steps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Time since the previous reading, credited to the state the machine was in then."""
    end = F.when(F.col("long_gap"), F.col("prev_at") + p.freshness_s).otherwise(F.col("obs_at"))
    return steps.where(F.col("prev_at") < end).select(
        "seq", "company_id", "machine_id", F.col("prev_at").alias("start_at"), end.alias("end_at"),
        is_running(F.col("prev_status")).alias("running"), is_manual(F.col("prev_mode")).alias("manual"),
        F.when(F.col("long_gap"), 0).otherwise(F.col("produced")).cast("long").alias("produced"),
    )


def production_slices(steps: DataFrame, calendar: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every amount a reading books, per shift and local hour.

    Up to three intervals leave a reading: its state time (with parts and, when
    the meter baseline is the same reading, energy), the meter's own interval,
    and zero-length bookings for a rise within one second. They are built as
    one array so that the steps are read once.
    """
    at, prev_at, m_from = F.col("obs_at"), F.col("prev_at"), F.col("meter_from")
    used = F.coalesce(F.col("energy_delta") > 0, F.lit(False))
    allocated = used & ~F.col("long_gap") & ~F.col("long_meter_gap")
    same_base = F.coalesce(m_from == prev_at, F.lit(False))
    none = F.lit(None).cast("double")

    def booking(start, end, timed, running, manual, produced, energy):
        return F.struct(start.alias("start_at"), end.alias("end_at"), timed.alias("timed"), running.alias("running"),
                        manual.alias("manual"), produced.cast("long").alias("produced"),
                        energy.cast("double").alias("energy"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    state_end = F.when(F.col("long_gap"), prev_at + p.freshness_s).otherwise(at)
    state = F.when(prev_at < state_end, booking(
        prev_at, state_end, yes, is_running(F.col("prev_status")), is_manual(F.col("prev_mode")),
        F.when(F.col("long_gap"), 0).otherwise(F.col("produced")),
        F.when(allocated & same_base, F.col("energy_delta")).otherwise(none)))
    parts_now = F.when(prev_at.isNotNull() & (F.col("gap_s") == 0) & (F.col("produced") > 0),
                       booking(at, at, no, no, no, F.col("produced"), none))
    meter = F.when(allocated & (~same_base | (at == m_from)),
                   booking(m_from, at, no, no, no, zero, F.col("energy_delta")))
    booked = steps.select("company_id", "machine_id", F.explode(F.array(state, parts_now, meter)).alias("_b")).where("_b IS NOT NULL")
    rows = booked.select("company_id", "machine_id", "_b.*")
    s = split_interval(rows, calendar_segments(calendar), "start_at", "end_at", p.zone_offset_s)
    timed = lambda flag: F.when(F.col("timed") & flag, F.col("seconds")).otherwise(0)
    whole = F.col("end_at") - F.col("start_at")
    share = F.when(whole > 0, F.col("energy") * F.col("seconds") / whole).otherwise(F.col("energy"))
    return s.select(
        "company_id", "machine_id", "shift_id", "hour_start",
        timed(F.col("running")).alias("run"), timed(~F.col("running")).alias("idle"),
        timed(F.col("manual")).alias("manual"),
        F.when(F.col("is_last"), F.col("produced")).otherwise(0).cast("long").alias("produced"),
        F.coalesce(share, F.lit(0.0)).alias("energy"),
    )


def production_hourly(slices: DataFrame) -> DataFrame:
    """Totals per machine, shift and local hour (partial sums before the shuffle)."""
    return slices.groupBy("machine_id", "shift_id", "hour_start").agg(
        F.min("company_id").alias("company_id"),
        F.sum("run").cast("long").alias("run_seconds"), F.sum("idle").cast("long").alias("idle_seconds"),
        F.sum("manual").cast("long").alias("manual_seconds"),
        F.sum("produced").cast("long").alias("produced_qty"), F.sum("energy").alias("energy_kwh"),
    )


def sum_hourly(rows: DataFrame) -> DataFrame:
    """Hourly rows of several batches added up per key."""
    return rows.groupBy("machine_id", "shift_id", "hour_start").agg(
        F.min("company_id").alias("company_id"),
        *[F.sum(c).alias(c) for c in
          ("run_seconds", "idle_seconds", "manual_seconds", "produced_qty", "energy_kwh")],
    )


def merge_hourly(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored hourly rows with a batch's totals added."""
    return sum_hourly(stored.unionByName(delta))


def unallocated_totals(gaps: DataFrame) -> DataFrame:
    """Per machine: parts and energy no hour could take, and the latest gap."""
    newest = F.max_by(F.struct("gap_from", "gap_to"), "seq")
    return gaps.groupBy("machine_id").agg(
        F.sum("unallocated_parts").alias("unallocated_parts"),
        F.sum(F.coalesce("unallocated_energy", F.lit(0.0))).alias("unallocated_energy"),
        newest.alias("_g"),
    ).select("machine_id", "unallocated_parts", "unallocated_energy",
             F.col("_g.gap_from").alias("last_gap_from"), F.col("_g.gap_to").alias("last_gap_to"))


def same_second(steps: DataFrame, calendar: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Readings inside a shift whose counter or meter rose within the second of its baseline: zero-length bookings."""
    parts = F.when(F.col("prev_at").isNotNull() & (F.col("gap_s") == 0), F.col("produced")).otherwise(0)
    used = F.coalesce(F.col("energy_delta") > 0, F.lit(False)) & (F.col("meter_from") == F.col("obs_at")) & ~F.col("long_gap")
    kwh = F.when(used, F.col("energy_delta")).otherwise(0.0)
    rises = steps.select("seq", "company_id", "machine_id", "obs_at", parts.cast("long").alias("produced"), kwh.alias("energy")
                         ).where((F.col("produced") > 0) | (F.col("energy") > 0))
    return split_interval(rises, calendar_segments(calendar), "obs_at", "obs_at", p.zone_offset_s).drop("slice_from", "seconds", "is_last")


def processing_counters(steps: DataFrame) -> DataFrame:
    """Backward counters, and the parts counted as unallocated: those of every reading that left a gap record."""
    gap = F.col("long_gap") | F.col("long_meter_gap")
    return steps.agg(F.count_if("regressed").alias("parts_counter_regression"),
                     F.sum(F.when(gap, F.col("produced")).otherwise(0)).cast("long").alias("unallocated_parts"))
