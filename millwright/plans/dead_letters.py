"""Queries: a journal of records as NDJSON files, read into a table with what cannot be read or held set aside."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millwright.functions.numbers import INT4
from millwright.operators.dead_letters import TableRules, records_of, storable
from millwright.plans.catalog import query
from millwright.plans.mapping import MAPPED, READINGS_SQL, readings
from millwright.session import checkpoint_dir

JOURNAL = MAPPED.with_(max_line_bytes=1_000)
SCHEMA = "s BIGINT, r STRUCT<machine_id: BIGINT, device_time: BIGINT, mode: STRING, parts_count: DOUBLE>"
RULES = TableRules("telemetry_raw", "telemetry_raw", {"mode": 32}, {"parts_count": INT4}, ("machine_id", "device_time"))

_MODE = "CASE WHEN k = 13 THEN repeat('x', 2000) WHEN k % 10 = 3 THEN repeat('M', 40) ELSE 'AUTO' END"
_RECORD = (f"""'{{"s":' || seq || ',"r":{{' || CASE WHEN k % 10 = 7 THEN '' ELSE '"machine_id":' || machine_id || ',' END || '"device_time":' || CAST(seq AS STRING)
  || ',"mode":"' || {_MODE}
  || '","parts_count":' || CASE WHEN k % 10 = 5 THEN '3000000000' ELSE CAST(k AS STRING) END || '}}}}'""")
LINE = f"""CASE WHEN k = 11 THEN '{{"s":' || seq || ',"r":{{"mach' WHEN k = 12 THEN '  ' WHEN k = 14 THEN 'lost ' || seq
  WHEN k = 16 THEN '{{"s":"' || seq || 'x"}}' ELSE {_RECORD} END"""


def journal(spark, d):
    """The journal's lines, written to files and read back as lines."""
    path = os.path.join(checkpoint_dir(spark), f"journal-{os.urandom(6).hex()}")
    readings(spark, d).selectExpr(f"{LINE} AS value").write.text(path)
    return records_of(spark.read.text(path), SCHEMA, JOURNAL)


def both(spark, d):
    records, lines = journal(spark, d)
    good, rows = storable(records.select(F.col("s").alias("seq"), "r.*"), RULES)
    return good, lines.unionByName(rows)


_LINES_SQL = f"WITH {READINGS_SQL}, ln AS (SELECT seq, machine_id, k, {LINE.replace('AS STRING', 'AS VARCHAR')} AS v FROM t WHERE k <> 12)"
_FAULT = "CASE WHEN k % 10 = 3 THEN '22001' WHEN k % 10 = 5 THEN '22003' WHEN k % 10 = 7 THEN '23502' END"


@query("dead_letters", f"""{_LINES_SQL} SELECT CASE WHEN k NOT IN (11, 13, 14, 16) THEN seq END AS seq,
    CASE WHEN k NOT IN (11, 13, 14, 16) AND k % 10 <> 7 THEN machine_id END AS machine_id,
    CASE k WHEN 11 THEN 'torn_record' WHEN 13 THEN 'oversized_record' WHEN 14 THEN 'corrupt_record' WHEN 16 THEN 'corrupt_record' ELSE 'database_rejected' END AS reason,
    CASE WHEN k NOT IN (11, 13, 14, 16) THEN {_FAULT} END AS code, CASE WHEN k NOT IN (11, 13, 14, 16) THEN 'telemetry_raw' END AS stage,
    CASE WHEN k NOT IN (11, 13, 14, 16) THEN 'telemetry_raw' END AS "table",
    CASE WHEN k NOT IN (11, 13, 14, 16) THEN CASE k % 10 WHEN 3 THEN 'mode' WHEN 5 THEN 'parts_count' ELSE 'machine_id' END END AS "column",
    CASE WHEN k IN (11, 13, 14, 16) THEN v[:1000] END AS raw, k = 13 AS truncated
  FROM ln WHERE k IN (11, 13, 14, 16) OR {_FAULT} IS NOT NULL""")
def dead_letters(spark, d):
    return both(spark, d)[1].withColumn("raw", F.when(F.col("reason") != "database_rejected", F.col("raw")))


@query("storable_rows", f"""{_LINES_SQL} SELECT seq, machine_id, seq AS device_time, 'AUTO' AS mode, k AS parts_count FROM ln
  WHERE k NOT IN (11, 13, 14, 16) AND {_FAULT} IS NULL""")
def storable_rows(spark, d):
    """The good rows, written and read back."""
    path = os.path.join(checkpoint_dir(spark), f"storable-{os.urandom(6).hex()}")
    both(spark, d)[0].withColumn("parts_count", F.col("parts_count").cast("long")).write.parquet(path)
    return spark.read.parquet(path)
