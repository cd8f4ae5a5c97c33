"""Keyed state whose rows come in order."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECK = "spark.sql.streaming.unsupportedOperationCheck"


def in_order(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows dealt by key and sorted by key and ``order`` within each task.

    A state operator grouped by ``keys`` needs just this distribution and a sort by key, so it takes the rows as they are
    and hands them to the processor in order, one at a time: no list of a key's rows is ever held. Processors check it.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


@contextmanager
def sorted_streams(spark: SparkSession):
    """Streams started inside may sort within tasks, which Spark refuses by default as it cannot tell a sort of a
    micro-batch from one of the whole stream."""
    before = spark.conf.get(CHECK, "true")
    spark.conf.set(CHECK, "false")
    try:
        yield
    finally:
        spark.conf.set(CHECK, before)
