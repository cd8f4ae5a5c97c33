"""Writers: append tables, merged tables, and the split of rows a table cannot hold."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.alarms import alarm_periods, critical_events
from millwright.session import checkpoint_dir, scratch_table


def write_alarm_tables(timeline: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Periods and notification events of one batch, written from one computed timeline."""
    root = path or os.path.join(checkpoint_dir(timeline.sparkSession), f"alarms-{os.urandom(6).hex()}")
    once = scratch_table(timeline, "timeline")
    out = []
    for name, rows in (("machine_alarms", alarm_periods(once)), ("alarm_notification_events", critical_events(once))):
        rows.write.mode("overwrite").parquet(os.path.join(root, name))
        out.append(timeline.sparkSession.read.schema(rows.schema).parquet(os.path.join(root, name)))
    return out[0], out[1]


def write_alarm_state(periods: DataFrame, events: DataFrame | None, path: str, batch: int) -> None:
    """One batch's periods and notifications.

    ``periods`` are those that were open before the batch or opened in it. Ended ones never change again and are added
    under the batch's number; open ones are written anew, so a batch costs what is open, not what is on record. Everything
    lies under the batch's number, so a batch written again replaces itself. A line in ``batches`` comes last: until it is
    there, readers see the batch before.
    """
    ended = F.col("ended_at").isNotNull()
    done = periods.sparkSession.range(int(batch), int(batch) + 1, 1, 1).withColumnRenamed("id", "number")
    for name, rows in (("ended", periods.where(ended)), ("open", periods.where(~ended)), ("notifications", events), ("batches", done)):
        if rows is not None:
            rows.write.mode("overwrite").parquet(os.path.join(path, name, f"batch={int(batch)}"))


def read_alarm_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All periods after the newest whole batch, and the notifications up to it."""
    live = spark.read.parquet(os.path.join(path, "open"))
    newest = spark.read.parquet(os.path.join(path, "batches")).agg(F.max("batch")).first()[0]
    ended = spark.read.parquet(os.path.join(path, "ended")).where(F.col("batch") <= newest)
    events = spark.read.parquet(os.path.join(path, "notifications")).where(F.col("batch") <= newest).drop("batch")
    return live.where(F.col("batch") == newest).unionByName(ended).drop("batch"), events


def write_by_day(rows: DataFrame, path: str, received_ms: str = "recv_ms") -> None:
    """Append, partitioned by receipt date, so that retention drops whole partitions."""
    rows.withColumn("received_on", F.timestamp_millis(received_ms).cast("date")).write.mode("append").partitionBy(
        "received_on").parquet(path)
