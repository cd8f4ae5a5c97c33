"""Readings that must not be lost or misread: repeated keys, look-alike texts, odd numbers, old copies, lagging collectors."""

import os
import random

from pyspark.sql import functions as F

from millwright.functions.clock import time_to_seconds
from millwright.functions.payload import block_of, canonical, fingerprint, object_of
from millwright.functions.signals import identity_columns, process_columns
from millwright.operators import admission, alarms, quality, tables
from millwright.params import DEFAULTS
from millwright.streaming.dedup import without_copies
from millwright.streaming.ordered import sorted_streams
from millwright.streaming.stateful import use_rocksdb


def prints(spark, *payloads):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i INT, p STRING")
    return [r.f for r in rows.select("i", fingerprint(F.col("p")).alias("f")).orderBy("i").collect()]


def test_fingerprints_tell_texts_apart_and_numbers_by_value(spark):
    a, b, c, d = prints(spark, '{"version":"1.0"}', '{"version":"1"}', '{"version":"rev 2.00"}', '{"version":"rev 2"}')
    assert len({a, b, c, d}) == 4
    assert len(set(prints(spark, '{"a":1.50,"b":[2.0,{"x":"1.0"}]}', '{"b":[2,{"x":"1.0"}],"a":1.5}'))) == 1
    quoted = prints(spark, r'{"a":"say \"1.0,\" twice"}', r'{"a":"say \"1,\" twice"}')
    assert len(set(quoted)) == 2


def test_fingerprints_of_repeated_nested_keys_are_never_null(spark):
    a, b, c, d = prints(spark, '{"time":1,"m":{"x":1,"x":2}}', '{"time":2,"m":{"x":1,"x":2}}', '{"time":1,"m":{"x":1,"x":2}}', '{"time":1,"m":{"x":3,"x":2}}')
    assert None not in (a, b, c, d) and a == c and len({a, b, d}) == 3


def test_the_last_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([('{"parts_count":1,"parts_count":2}', '{"X":1,"X":2}')], "p STRING, b STRING")
    r = df.select(canonical(object_of(F.col("p")))["parts_count"].alias("top"), block_of(F.col("b"))["X"].alias("nested")).first()
    assert (r.top, r.nested) == ("2", "2")


def test_odd_numbers_fail_no_job(spark):
    df = spark.createDataFrame([("1e12", "12 rpm"), ("3.7 axes", "true"), ("-4", "12.9"), ("x", "42279658848"), (None, ""), (None, "1e2"), (None, " ")], "axes STRING, status STRING")
    fields = F.create_map(F.lit("controlled_axes"), "axes", F.lit("status"), "status")
    rows = df.select(identity_columns(fields)["controlled_axes"].alias("axes"), process_columns(fields)["status"].alias("status")).collect()
    assert [r.axes for r in rows] == [None, 3, -4, None, None, None, None]
    assert [r.status for r in rows] == [None, 1, 12, None, None, 100, 0]
    times = spark.createDataFrame([("06:30",), ("soon",), ("7:x:9",)], "t STRING").select(time_to_seconds(F.col("t")).alias("s")).collect()
    assert [r.s for r in times] == [23_400, None, 25_209]
    raw = spark.createDataFrame([(1, 0, 5, "abc"), (1, 1, 6, "7")], "machine_id INT, seq INT, recv_ms LONG, status STRING")
    assert [(r.violations, r.first_value, r.first_sent) for r in quality.range_violations(raw, ["status"]).collect()] == [(1, None, "abc")]


def test_a_copy_is_forgotten_after_the_time_to_live(spark):
    rows = [(1, "a", 1, 0), (1, "a", 2, 299_000), (1, "a", 3, 700_000), (1, None, 4, 0), (1, None, 5, 1), (2, "a", 6, 0)]
    df = spark.createDataFrame(rows, "machine_id INT, fingerprint STRING, seq LONG, recv_ms LONG")
    got = {r.seq: r.is_first for r in admission.first_copies(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}


def test_copies_count_from_the_one_taken_in(spark):
    rng = random.Random(8)
    rows, seq = [], 0
    for m in (1, 2):
        for name, n, span in (("a", 400, 9_000_000), ("b", 3, 700_000), ("c", 1, 1), ("hot", 900, 1_300_000), ("slow", 30, 60_000_000)):
            for at in sorted(rng.randrange(0, span) for _ in range(n)):
                rows.append([m, name, 0, at])
    rows += [[3, "steady", 0, i * 200_000] for i in range(40)] + [[4, None, 0, 5]] * 3
    rows = [(m, f, i, at) for i, (m, f, _, at) in enumerate(sorted(rows, key=lambda r: r[3]))]
    held, want = {}, {}
    for m, f, i, at in rows:
        want[i] = f is None or (m, f) not in held or at - held[(m, f)] >= 300_000
        if want[i]:
            held[(m, f)] = at
    df = spark.createDataFrame(rows, "machine_id INT, fingerprint STRING, seq LONG, recv_ms LONG")
    for width in (1 << 24, 16):
        got = {r.seq: r.is_first for r in admission.first_copies(df, DEFAULTS.with_(chunk_seqs=width)).collect()}
        assert got == want
    assert [i for i, r in enumerate(x for x in rows if x[0] == 3) if want[r[2]]] == list(range(0, 40, 2))


def test_a_lagging_collector_loses_nothing(spark, tmp_path):
    schema = "machine_id INT, fingerprint STRING, seq LONG, recv_ms LONG"
    steps = [[(1, "a", 1, 2_000_000), (1, "a", 2, 2_001_000)], [(2, "b", 3, 1_100_000), (1, "a", 4, 2_002_000)], [(3, "c", 5, 900_000), (3, None, 6, 1), (3, None, 7, 1)]]
    use_rocksdb(spark)
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, "in", f"step={i}"))
        stream = without_copies(spark.readStream.schema(schema).parquet(os.path.join(tmp_path, "in", "*")))
        with sorted_streams(spark):
            going = stream.writeStream.format("parquet").option("path", os.path.join(tmp_path, "out")).option(
                "checkpointLocation", os.path.join(tmp_path, "checkpoint")).trigger(availableNow=True).start()
        going.awaitTermination()
    out = spark.read.schema(schema).parquet(os.path.join(tmp_path, "out")).collect()
    assert {r.seq for r in out} == {1, 3, 5, 6, 7}


def test_a_registry_that_was_seen_before_is_updated(spark):
    machines = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "machine_id INT, series STRING, controller_seen_at LONG")
    seen = spark.createDataFrame([(1, "z", 9, 1)], "machine_id INT, series STRING, recv_s LONG, seq LONG")
    rows = {r.machine_id: (r.series, r.controller_seen_at) for r in tables.identity_update(machines, seen, ["series"]).collect()}
    assert rows == {1: ("z", 9), 2: ("y", 6)}


def test_every_severity_observation_is_applied_in_order(spark):
    schema = "company_id INT, machine_id INT, alarm_key STRING, started_at LONG, ended_at LONG, severity STRING, observed_at LONG, observed_recv_ms LONG"
    periods = spark.createDataFrame([(1, 1, "A", 100, None, "LOW", 100, 100_000), (1, 1, "B", 100, None, "LOW", None, None)], schema)
    told = [("A", 1, 110, "FATAL"), ("A", 2, 105, "LOW"), ("A", 3, 120, "CRITICAL"), ("B", 4, 110, "FATAL"), ("B", 5, 120, "LOW"), ("B", 6, 130, "LOW"), ("A", 7, 90, "LOW")]
    seen = spark.createDataFrame([(1, 1, k, n, at, at * 1000, s) for k, n, at, s in told], "company_id INT, machine_id INT, alarm_key STRING, seq LONG, obs_at LONG, recv_ms LONG, severity STRING")
    got = {r.alarm_key: (r.severity, r.observed_at, r.priority_changed_at) for r in alarms.priority_match(seen, periods).collect()}
    assert got == {"A": ("CRITICAL", 120, 110), "B": ("LOW", 130, 120)}
    events = {(r.alarm_key, r.occurred_at, r.severity) for r in alarms.priority_events(seen, periods).collect()}
    assert events == {("A", 110, "FATAL"), ("B", 110, "FATAL")}


def test_changes_compare_stored_severities_and_keep_batteries(spark):
    alarm = "ARRAY<STRUCT<alarm_key: STRING, severity: STRING>>"
    rows = [(1, 1, 1, [("A", None), ("FANUC_ACC_SV_LOW", "LOW"), ("FANUC_ACC_X_LOW", "LOW")], False, None), (1, 1, 2, [("A", " low ")], True, ["FANUC_ACC_X_LOW"]),
            (1, 1, 3, [("A", "LOW")], False, None)]
    df = spark.createDataFrame(rows, f"company_id INT, machine_id INT, seq LONG, alarms {alarm}, preserve_battery BOOLEAN, battery_clears ARRAY<STRING>")
    got = {r.seq: r for r in alarms.alarm_diff(df).collect()}
    assert got[2].updates == ["A"] and got[3].updates == []
    assert got[2].closes == ["FANUC_ACC_X_LOW"] and sorted(got[1].keep) == ["A", "FANUC_ACC_SV_LOW", "FANUC_ACC_X_LOW"] and got[2].keep is None
