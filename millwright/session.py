"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "millwright", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings these jobs are tuned for.

    Shuffle partitions start high on a cluster and are merged by AQE; hot join
    keys are split by AQE skew handling; a join side is broadcast only when its
    measured size is under the threshold.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="millwright-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the checkpoint folder and read on from there.

    Used between scans that feed each other, so that the earlier scan is
    computed once and lost executors re-read files instead of recomputing.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back by columns."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{os.urandom(6).hex()}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HUGE = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession):
    """Plans that run inside leave no generated method above 8,000 bytes, which the JVM would never compile.

    A projection of long text expressions is such a method; without whole-stage code it is cut into small ones.
    """
    before = spark.conf.get(HUGE)
    spark.conf.set(HUGE, "8000")
    try:
        yield
    finally:
        spark.conf.set(HUGE, before)


def dealt(rows: DataFrame, keys: list[str], rows_per_task: int = 1 << 18) -> DataFrame:
    """Written ``rows`` dealt by ``keys`` to as many tasks as their number asks for, so that what a task holds does not grow.

    Left to itself a shuffle has a fixed number of partitions, and AQE merges them by their compressed size, in which a
    table of aggregates takes a twentieth of its memory.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_task))
    return rows.repartition(tasks, *keys)
