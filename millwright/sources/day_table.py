"""A table that batches are merged into, kept in a folder a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators.meters import meter_merge
from millwright.operators.production import merge_hourly
from millwright.session import scratch_table

DAY, BATCH = "day", "merged_batch"


class DayTable:
    """Rows partitioned by the UTC day of ``second``; a batch reads and rewrites the days it touches, and no other.

    ``merge(stored, new)`` gives the rows of the touched days; ``schema`` is that of its result. Every row carries the
    number of the batch that wrote its day last. Days are replaced one by one, so a batch that is written again, whole or
    from where it was cut off, finds which of its days hold it already and leaves those alone: sums are not added twice.
    Batches come with rising numbers. Files of a day are written anew together, few and of even size.
    """

    def __init__(self, root: str, second: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]):
        self.root, self.second, self.schema, self.merge = root, second, schema, merge

    def _stored(self, spark: SparkSession) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        schema = f"{self.schema}, {BATCH} BIGINT, {DAY} BIGINT"
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.root)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(BATCH, DAY)

    def upsert(self, new: DataFrame, batch: int) -> list[int]:
        """Merge one batch; returns the days that were rewritten, as days since 1970. Rows need a time."""
        spark = new.sparkSession
        own = scratch_table(new.withColumn(DAY, F.floor(F.col(self.second) / 86400).cast("long")), "day-batch")
        days = [r[0] for r in own.select(DAY).distinct().collect()]  # as many as a batch has calendar days
        if None in days:
            raise ValueError(f"rows without {self.second} belong to no day")
        stored = self._stored(spark)
        held = {r[0] for r in stored.where(F.col(DAY).isin(days)).groupBy(DAY).agg(F.max(BATCH).alias("b")).where(F.col("b") >= batch).collect()}
        touched = sorted(set(days) - held)
        if touched:
            mine = F.col(DAY).isin(touched)
            merged = self.merge(stored.where(mine).drop(BATCH, DAY), own.where(mine).drop(DAY))
            rows = merged.withColumn(BATCH, F.lit(batch).cast("long")).withColumn(DAY, F.floor(F.col(self.second) / 86400).cast("long"))
            rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.root)
        return touched


def hourly_table(root: str) -> DayTable:
    """Production hours; a batch's totals are added to what an hour holds."""
    return DayTable(root, "hour_start", "machine_id BIGINT, shift_id BIGINT, hour_start BIGINT, company_id BIGINT, run_seconds BIGINT, idle_seconds BIGINT, "
                    "manual_seconds BIGINT, produced_qty BIGINT, energy_kwh DOUBLE", merge_hourly)


def meter_table(root: str, fields: dict[str, str]) -> DayTable:
    """Meter rows by machine and second; ``fields``: the meter columns and their types. A batch has observations."""
    columns = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    return DayTable(root, "read_at", f"machine_id BIGINT, read_at BIGINT, company_id BIGINT, standalone BOOLEAN, {columns}, standalone_fields ARRAY<STRING>",
                    lambda stored, new: meter_merge(stored, new, tuple(fields)))
