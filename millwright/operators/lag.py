"""How late readings arrive: latest lag, late windows, late episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators.scan import last, prev, scan
from millwright.params import DEFAULTS, Params


def lag_snapshot(readings: DataFrame, now_ms: int, p: Params = DEFAULTS) -> DataFrame:
    """Latest lag of every machine heard recently; negative when its clock is ahead."""
    newest = readings.groupBy("machine_id").agg(F.max_by(F.struct("recv_ms", "lag_ms"), "seq").alias("_n"))
    return newest.where(F.lit(now_ms) - F.col("_n.recv_ms") <= p.forget_ms).select(
        "machine_id", F.col("_n.lag_ms").alias("lag_ms"))


def worst_lag(snapshot: DataFrame) -> DataFrame:
    return snapshot.orderBy(F.col("lag_ms").desc(), "machine_id").limit(1)


def severity_step(lag_ms: Column, p: Params = DEFAULTS) -> Column:
    return sum(((lag_ms > s).cast("int") for s in p.steps_ms), F.lit(0))


def late_windows(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Late readings per aligned window and machine: how many, how late, how severe."""
    window = (F.floor(F.col("recv_ms") / (p.lag_window_s * 1000)) * p.lag_window_s).cast("long")
    late = readings.where(F.col("lag_ms") > p.late_ms).groupBy("machine_id", window.alias("window_start")).agg(
        F.count("*").alias("late_readings"), F.max("lag_ms").alias("worst_ms"))
    return late.withColumn("step", severity_step(F.col("worst_ms"), p))


def lag_episodes(readings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Start of every run of late readings and the first later reading on time (null: not recovered)."""
    late = F.col("lag_ms") > p.late_ms
    s = scan(readings.select("machine_id", "seq", "recv_ms", "lag_ms"), ["machine_id"],
             before={"_was": prev(late)}, after={"recovered_ms": last(F.when(~late, F.col("recv_ms")))}, width=p.chunk_seqs)
    return s.where(late & ~F.coalesce(F.col("_was"), F.lit(False))).select(
        "machine_id", F.col("seq").alias("started_seq"), F.col("recv_ms").alias("started_ms"), "recovered_ms")
