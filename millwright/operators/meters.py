"""Merging sparse meter observations of one second into one row, and the latest value of every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.meter import NAMES

KEY = ["machine_id", "read_at"]
_STANDALONE = 1 << 62  # ranks every standalone value above every other


def _bit(i: int) -> Column:
    return F.lit(1 << i).cast("long")


def as_observations(stored: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """Stored rows in the form of observations older than any new one."""
    mask = sum((F.when(F.array_contains("standalone_fields", n), _bit(i)).otherwise(_bit(i) * 0)
                for i, n in enumerate(fields)), F.lit(0).cast("long"))
    return stored.select(*KEY, "company_id", F.lit(-1).cast("long").alias("seq"), "standalone", mask.alias("alone"), *fields)


def with_mask(observations: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """Adds ``alone``: one bit per field that this packet supplies as a standalone reading."""
    mask = sum((F.when(F.col("standalone") & F.col(n).isNotNull(), _bit(i)).otherwise(_bit(i) * 0)
                for i, n in enumerate(fields)), F.lit(0).cast("long"))
    return observations.select(*KEY, "company_id", "seq", "standalone", mask.alias("alone"), *fields)


def merge_observations(observations: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """One row per (machine, second): the latest standalone value of a field, else its latest value.

    The row belongs to the company seen first; other companies' observations of
    the key are ignored. Folding per company first keeps both steps plain
    aggregates with partial sums, whatever the size of a key's group.
    """
    def rank(i):
        return F.col("seq") + F.when(F.col("alone").bitwiseAND(_bit(i)) != 0, F.lit(_STANDALONE)).otherwise(F.lit(0))

    per_company = observations.groupBy(*KEY, "company_id").agg(
        F.min("seq").alias("_first"), F.bool_or("standalone").alias("standalone"), F.bit_or("alone").alias("alone"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), rank(i))).alias(n) for i, n in enumerate(fields)])
    row = F.struct("company_id", "standalone", "alone", *fields)
    owner = per_company.groupBy(*KEY).agg(F.min_by(row, "_first").alias("_r")).select(*KEY, "_r.*")
    names = F.array_compact(F.array(*[F.when(F.col("alone").bitwiseAND(_bit(i)) != 0, n) for i, n in enumerate(fields)]))
    return owner.withColumn("standalone_fields", F.array_sort(names)).drop("alone")


def meter_merge(stored: DataFrame, new: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """Stored rows with a batch of observations merged in; a row never changes company."""
    return merge_observations(as_observations(stored, fields).unionByName(with_mask(new, fields)), fields)


def meter_observations(snapshots: DataFrame, standalone: DataFrame, late: DataFrame) -> DataFrame:
    """Meter readings of every lane; late ones keep their own time."""
    return snapshots.unionByName(standalone).unionByName(late)


def latest_fields(observations: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """Per machine and field: last value and the time it was observed."""
    wide = observations.groupBy("machine_id").agg(*[F.max_by(
        F.struct(F.col(n).cast("double").alias("value"), F.col("read_at").alias("observed_at")),
        F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in fields])
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("v")) for n in fields])
    return wide.select("machine_id", F.explode(pairs).alias("_p")).where("_p.v IS NOT NULL").select(
        "machine_id", "_p.field", "_p.v.value", "_p.v.observed_at")
