"""Streams over several micro-batches: stateful rules against walks, and the machine stream's failure handling."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwright.operators import admission, alarms, production, tables
from millwright.params import Params
from millwright.session import materialise, scratch_table
from millwright.sources.messages import stream_messages
from millwright.sources.sinks import write_by_day
from millwright.sources.versions import VersionedTable
from millwright.streaming import stateful
from millwright.streaming.dedup import FirstCopies
from millwright.streaming.machine import PACKET, STEP_FIELDS, GroupWalk, MachineStream, blocks_of, initial_states


def drain(spark, rows, operator, p, path, order, cut):
    stateful.use_rocksdb(spark)
    for i, part in enumerate((F.col(order) <= cut, F.col(order) > cut)):
        rows.where(part).write.parquet(os.path.join(path, "in", f"step={i}"))
        stream = operator(spark.readStream.schema(rows.schema).parquet(os.path.join(path, "in", "*")), p)
        stream.writeStream.format("parquet").option("path", os.path.join(path, "out")).option(
            "checkpointLocation", os.path.join(path, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(path, "out")).collect()


def test_identity_writes(spark, tmp_path):
    rows = [(m, i * 3 + m, i * 900_000, "a" if i % 11 else "b") for m in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "machine_id BIGINT, seq BIGINT, recv_ms BIGINT, identity STRING")
    got = {(r.machine_id, r.seq) for r in drain(spark, df, stateful.identity_writes, Params(), str(tmp_path), "recv_ms", 17_000_000)}
    want, held = set(), {}
    for m, seq, ms, identity in sorted(rows, key=lambda r: r[1]):
        if m not in held or held[m][0] != identity or ms - held[m][1] >= 3_600_000:
            held[m] = (identity, ms)
            want.add((m, seq))
    assert got == want


def test_lag_alerts(spark, tmp_path):
    minute = 60_000
    told = [(1, 0, 1, 15_000), (1, 1, 1, 16_000), (1, 2, 1, 70_000), (2, 2, 2, 12_000), (1, 3, 1, 130_000), (2, 4, 2, 1_000),
            (1, 19, 1, 130_000), (1, 20, 1, 500)]
    rows = [(7, m, w * 100 + m, w * minute + 30_000, lag) for m, w, _, lag in told]
    df = spark.createDataFrame(rows, "plant_id BIGINT, machine_id BIGINT, seq BIGINT, recv_ms BIGINT, lag_ms BIGINT")
    windows = stateful.machine_windows(df)
    got = sorted((r.window_start // 60, r.kind, r.level, tuple(r.machines)) for r in drain(
        spark, windows, stateful.lag_alerts, Params(), str(tmp_path), "window_start", 150))
    assert got == [(0, "late", "warn", (1,)), (2, "late", "warn", (1, 2)), (3, "late", "error", (1,)), (4, "recovered", "info", (2,)),
                   (19, "late", "error", (1,)), (20, "recovered", "info", (1,))]


def packet(machine, seq, at, recv_ms, **fields):
    return (seq, f"machines/k{machine}/telemetry", json.dumps({"time": at, **fields}), recv_ms)


@pytest.fixture(scope="module")
def packets():
    """Two machines: copies 200 s apart, late ones, meter-only packets, alarms that open and close, counters and meters."""
    rng, rows, seq, count, kwh = random.Random(6), [], 0, 10, 100.0
    for i in range(60):
        at = 1_704_100_000 + 45 * i + (200 if i >= 30 else 0)
        for m in (1, 2):
            seq += 1
            count += rng.randrange(0, 3)
            kwh = round(kwh + rng.random(), 3)
            alarm = {"pmc_alarm": {"exist": 1, "alarms": [{"code": "A1", "severity": "critical" if i % 4 else "low"}, {"code": f"B{i % 3}"}]}} if i % 5 else {}
            rows.append(packet(m, seq, at, at * 1000 + 500, machine_status=rng.choice(["RUN", "STOP"]), mode="AUTO", parts_count=count, Energy=kwh, **alarm))
            if i % 7 == 0:
                seq += 1
                rows.append(packet(m, seq, at + 5, at * 1000 + 6_000, energy=kwh + 0.01))
            if i % 11 == 0:
                seq += 1
                rows.append(packet(m, seq, at - 200, at * 1000 + 7_000, machine_status="RUN", parts_count=1))
    resent = packet(1, 0, 1_704_100_010, 0, machine_status="RUN", parts_count=9)
    rows += [(0, resent[1], resent[2], 1_704_100_011_000 + 200_000 * k) for k in range(6)]
    return [(i, topic, text, ms) for i, (_, topic, text, ms) in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))]


def machines(spark):
    return spark.createDataFrame([(1, "k1", 5, 9, "FANUC", True), (2, "k2", 5, 9, "OTHER", True)],
                                 "machine_id BIGINT, api_key STRING, company_id BIGINT, plant_id BIGINT, controller_type STRING, is_active BOOLEAN")


def versions(spark, path):
    table = VersionedTable(path)
    table.publish(spark.createDataFrame([(1, 5, 0, 43_200), (2, 5, 43_200, 0)], "shift_id BIGINT, company_id BIGINT, start_s INT, end_s INT"))
    return table


def streamed(spark, df, root, cuts, calendar, **options):
    stateful.use_rocksdb(spark)
    job = MachineStream(os.path.join(root, "tables"), machines(spark), calendar.pinned, **options)
    for i, (a, b) in enumerate(zip((-1, *cuts), (*cuts, 1 << 40))):
        df.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.json(os.path.join(root, "in", f"step={i}"))
        job.start(stream_messages(spark, os.path.join(root, "in", "*")), os.path.join(root, "checkpoint")).awaitTermination()
    return job


def told(out, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.select(*columns).collect())


HOURS = ("machine_id", "shift_id", "hour_start", "run_seconds", "idle_seconds", "produced_qty", "energy_kwh")
GAPS = ("seq", "machine_id", "gap_from", "gap_to", "unallocated_parts", "unallocated_energy")


def test_machine_stream_equals_the_batch_and_survives_a_repeat(spark, packets, tmp_path):
    df = spark.createDataFrame(packets, "seq BIGINT, topic STRING, payload STRING, recv_ms BIGINT")
    calendar = versions(spark, str(tmp_path / "calendar"))
    job = streamed(spark, df, str(tmp_path), (40, 90), calendar)
    outcome = told(admission.classify(df, machines(spark)).where("outcome NOT IN ('invalid')"), "seq", "outcome")
    assert told(job.read(spark, "steps"), "seq", "outcome") == outcome
    resent = [r.outcome for r in job.read(spark, "steps").where("payload LIKE '%1704100010%'").orderBy("seq").collect()]
    assert resent == ["accepted", "duplicate", "late_stale", "duplicate", "late_stale", "duplicate"]
    steps = production.production_steps(admission.accepted_readings(df, machines(spark)))
    slices = production.production_slices(steps, calendar.pinned(spark)[1])
    hours, gaps = told(production.production_hourly(slices), *HOURS), told(production.gap_records(steps), *GAPS)
    assert told(job.hourly(spark), *HOURS) == hours and told(job.read(spark, "gaps"), *GAPS) == gaps and hours and gaps
    again = scratch_table(spark.read.parquet(job.path("steps", 1)), "again")
    job.write(again, 1)
    assert told(job.hourly(spark), *HOURS) == hours and told(job.read(spark, "gaps"), *GAPS) == gaps
    held = alarms.alarm_state(blocks_of(df.join(admission.classify(df, machines(spark)).where("outcome = 'accepted' AND NOT is_energy").drop("recv_ms"), "seq")))
    events = alarms.alarm_events(alarms.alarm_diff(held))
    key = ("machine_id", "alarm_key", "kind", "seq")
    assert told(job.read(spark, "alarm_events"), *key) == told(events, *key)
    periods = ("machine_id", "alarm_key", "started_seq", "started_at", "ended_at")
    plain = alarms.alarm_periods(alarms.alarm_timeline(materialise(events)))
    key = lambda rows: sorted(map(repr, rows))
    assert key(map(tuple, job.periods(spark).select(*periods).collect())) == key(map(tuple, plain.select(*periods).collect()))


def test_a_cold_start_from_the_tables_goes_on_like_a_stream_that_never_stopped(spark, packets, tmp_path):
    df = spark.createDataFrame([r for r in packets if "1704100010" not in r[2]], "seq BIGINT, topic STRING, payload STRING, recv_ms BIGINT")
    calendar = versions(spark, str(tmp_path / "calendar"))
    some = ("late", "hourly", "gaps", "meters", "telemetry")
    whole = streamed(spark, df, str(tmp_path / "whole"), (80,), calendar, tables=some)
    first = lambda table: spark.read.parquet(whole.path(table, 0))
    now = df.where("seq <= 80").agg(F.max("recv_ms")).first()[0] // 1000
    stored = first("telemetry").withColumn("recv_s", F.unix_seconds("received_at"))
    energy = first("meters").where("kwh_total IS NOT NULL").select("machine_id", "seq", F.col("kwh_total").alias("energy"), F.col("read_at").alias("observed_at"), F.col("read_at").alias("recv_s"), "standalone")
    codes = spark.createDataFrame([], "machine_id BIGINT, codes ARRAY<STRING>")
    baseline = tables.bootstrap_baseline(machines(spark), stored, energy, codes, now + 60)
    cold = streamed(spark, df.where("seq > 80"), str(tmp_path / "cold"), (), calendar, tables=some, initial=initial_states(baseline))
    late = {r.seq for r in first("late").collect()}
    for table, columns in (("hourly", HOURS), ("gaps", GAPS)):
        assert told(spark.read.parquet(cold.path(table, 0)), *columns) == told(spark.read.parquet(whole.path(table, 1)), *columns)
    assert late and told(spark.read.parquet(cold.path("steps", 0)), "seq", "outcome") == told(spark.read.parquet(whole.path("steps", 1)), "seq", "outcome")


class Held(dict):
    """State variables of one key, in memory."""

    def getMapState(self, name, *_):
        return self.setdefault(name, Held())

    getValueState = getMapState

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return "value" in self

    def update(self, value):
        self["value"] = value

    def get(self, key="value"):
        return super().get(key)


def walked(state, *frames):
    walk = GroupWalk(Params())
    walk.init(state)
    return list(walk.handleInputRows((0,), iter([pd.DataFrame(f, columns=PACKET) for f in frames]), None))


def test_machines_that_are_walked_together_are_told_apart():
    at = 1_704_100_000
    row = lambda m, seq, t, h, count: (m, seq, 5, at + t, (at + t) * 1000, False, None, h, "RUN", None, count, [], "{}")
    state = Held()
    first = walked(state, [row(1, 0, 0, "a", 7), row(1, 2, 10, "a", 7), row(2, 1, 5, "a", 3)], [row(2, 3, 15, "b", None), row(3, 4, 1, "a", 9)])
    assert len(first) == 2  # one frame for all of a frame's machines
    out = pd.concat(first)[STEP_FIELDS]
    assert out["outcome"].tolist() == ["accepted", "duplicate", "accepted", "accepted", "accepted"]
    assert [None if v != v else v for v in out["prev_at"]] == [None, at, None, at + 5, None]
    assert [None if v != v else v for v in out["baseline_before"]] == [None, 7, None, 3, None]
    assert sorted(k for k, in state["held"]) == [1, 2, 3]
    again = walked(state, [row(2, 9, 20, "b", 4), row(2, 10, 400, "b", 4), row(3, 11, 2, "c", 9)])[0]
    assert again["outcome"].tolist() == ["duplicate", "accepted", "accepted"] and again["baseline_before"].tolist() == [3, 3, 9]
    for mixed in ([row(1, 20, 500, "x", 1), row(1, 19, 501, "y", 1)], [row(2, 30, 500, "x", 1), row(1, 31, 501, "y", 1)]):
        with pytest.raises(ValueError):
            walked(Held(), mixed)


def test_copies_of_machines_that_share_a_key_are_told_apart():
    hour, state = 3_600_000, Held()

    def let(*rows):
        copies = FirstCopies(Params(), ["machine_id", "seq"])
        copies.init(state)
        frame = pd.DataFrame(rows, columns=["machine_id", "fingerprint", "seq", "recv_ms"])
        return [tuple(r) for f in copies.handleInputRows((0,), iter([frame]), None) for r in f.itertuples(index=False)]

    assert let((1, "a", 0, 0), (2, "a", 1, 1_000), (1, "a", 2, 200_000), (2, "b", 3, 200_001)) == [(1, 0), (2, 1), (2, 3)]
    assert let((1, "a", 4, 300_000), (2, "a", 5, 300_000)) == [(1, 4)]
    # machine 1 is two days on: its own old copies go, machine 2's stay, as its collector lags behind
    assert let((1, "z", 6, 48 * hour)) == [(1, 6)]
    assert sorted(state["taken"]) == [(1, "z"), (2, "a"), (2, "b")]
    assert let((2, "b", 7, 400_000), (2, "a", 8, 400_000)) == [(2, 8)]


def test_a_version_that_lost_a_file_is_passed_over(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "dim"))
    rows = lambda n: spark.range(n).withColumn("v", F.lit(n)).repartition(2)
    assert table.publish(rows(10)) == 1 and table.publish(rows(20)) == 2
    assert table.pinned(spark)[0] == 2
    number, held = table.pinned(spark)
    folder = next(p for p in (tmp_path / "dim").iterdir() if p.name.startswith("version-2-"))
    next(folder.glob("part-*")).unlink()
    assert table.pinned(spark)[0] == 1 and table.pinned(spark)[1].count() == 10
    assert held.count() == 20  # who holds a version keeps it


def test_rows_are_partitioned_by_receipt_day(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1_704_067_199_000), (2, 1_704_067_200_000)], "seq BIGINT, recv_ms BIGINT")
    write_by_day(df, path)
    got = {(r.seq, str(r.received_on)) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "2023-12-31"), (2, "2024-01-01")}
