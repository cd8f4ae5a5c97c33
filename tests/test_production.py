"""Counter, meter, slice and gap rules against sequential walks and known values."""

import random

import pytest
from pyspark.sql import functions as F

from millwright.operators import production as ops
from millwright.operators.admission import meter_order
from millwright.operators.shifts import shift_calendar
from millwright.params import Params

P = Params(chunk_seqs=7)
READ = "machine_id BIGINT, company_id BIGINT, seq BIGINT, obs_at BIGINT, machine_status STRING, mode STRING, parts_count BIGINT, energy DOUBLE"
T0 = 1_700_000_000


def calendar(spark):
    rows = [(1, 9, "06:00", "14:00", True), (2, 9, "14:00", "22:00", True), (3, 9, "22:00", "06:00", True)]
    return shift_calendar(spark.createDataFrame(rows, "id BIGINT, company_id BIGINT, start_time STRING, end_time STRING, is_active BOOLEAN"))


@pytest.mark.parametrize("baseline,count,gap,expected", [
    (None, 5, 0, 0), (10, 12, 2, 2), (10, 0, 2, 0), (28, 2, 2, 2), (28, 9, 2, 0), (0, 28, 2, 0), (0, 28, 300, 28),
    (7, 150, 2, 0), (7, 150, 400, 143), (10, 30, 2, 20), (10, 31, 2, 0), (3, 5_004, 300, 0), (3, 5_003, 300, 5_000)])
def test_parts_delta(spark, baseline, count, gap, expected):
    df = spark.createDataFrame([(baseline, count, gap)], "b BIGINT, c BIGINT, g BIGINT")
    assert df.select(ops.parts_delta(F.col("b"), F.col("c"), F.col("g"))).first()[0] == expected


@pytest.mark.parametrize("meter,at,reading,now,expected", [
    (None, None, 5.0, 10, None), (5.0, 0, 0.0, 10, None), (5.0, 0, None, 10, None), (5.0, 0, 5.5, 10, 0.5), (5.0, 0, 4.0, 10, 0.0),
    (5.0, 0, 5.4e15, 10, 0.0), (5.0, 0, 171.0, 300, 166.0), (5.0, 0, 172.0, 300, 0.0)])
def test_energy_delta(spark, meter, at, reading, now, expected):
    df = spark.createDataFrame([(meter, at, reading, now)], "m DOUBLE, a BIGINT, r DOUBLE, n BIGINT")
    got = df.select(ops.energy_delta(F.col("m"), F.col("a"), F.col("r"), F.col("n"))).first()[0]
    assert got == expected


def fleet(seed, n=300):
    rng = random.Random(seed)
    clock, out = {1: T0, 2: T0}, []
    for seq in range(n):
        m = rng.choice([1, 1, 2])
        clock[m] += rng.choice([0, 1, 5, 59, 61, 400])
        out.append((m, 9, seq, clock[m], rng.choice(["RUN", "cutting", "STOP", None]), rng.choice(["MANUAL", "AUTO", "setup", None]),
                    rng.choice([None, 0, 1, 2, 3, 6, 11, 30, 31, 60]), rng.choice([None, 0.0, 1.0, 1.5, 2.0, 400.0, 401.0])))
    return out


def walk(rows):
    state, out = {}, {}
    for m, _, seq, at, status, mode, count, kwh in sorted(rows, key=lambda r: r[2]):
        s = state.setdefault(m, {"at": None, "base": None, "meter": None, "unsure": False})
        gap = 0 if s["at"] is None else max(0, at - s["at"])
        delta, back = 0, False
        b = s["base"]
        if count is not None and b is not None:
            if count < b:
                back = count > 2
                delta = count if count <= 2 else 0
            elif not (count - b >= 5 and b <= 2 and gap < 300) and count - b <= (5_000 if gap >= 300 else 20):
                delta = count - b
        if back:
            s["unsure"] = True
        elif count is not None and (b is None or count <= 2 or count > b):
            s["unsure"] = False
        if count is not None and not back:
            s["base"] = count
        used, start = None, s["meter"][1] if s["meter"] else at
        if kwh is not None and kwh > 0:
            if s["meter"]:
                step = kwh - s["meter"][0]
                used = 0.0 if step < 0 or step > 2_000 * max(at - s["meter"][1], 300) / 3_600 else step
            s["meter"] = (kwh, at)
        out[(m, seq)] = (gap, b, delta, back, s["unsure"], used, start)
        s["at"] = at
    return out


def test_steps_match_walk(spark):
    rows = fleet(3)
    df = spark.createDataFrame(rows, READ)
    got = {(r.machine_id, r.seq): r for r in ops.production_steps(df, P).collect()}
    unsure = {(r.machine_id, r.seq): r.uncertain for r in ops.counter_uncertain(ops.counter_steps(df, P), P).collect()}
    for key, (gap, base, delta, back, doubt, used, start) in walk(rows).items():
        r = got[key]
        assert (r.gap_s, r.baseline_before, r.produced, r.regressed, unsure[key], r.energy_delta, r.meter_from) == (
            gap, base, delta, back, doubt, used, start), key


def test_nothing_is_lost(spark):
    """Every booked part and kWh is in an hour or in a gap record; every short interval's seconds are kept."""
    rows = fleet(5)
    steps = ops.production_steps(spark.createDataFrame(rows, READ), P).cache()
    hourly = ops.production_hourly(ops.production_slices(steps, calendar(spark), P)).agg(
        F.sum("produced_qty"), F.sum("energy_kwh"), F.sum(F.col("run_seconds") + F.col("idle_seconds"))).first()
    gaps = ops.gap_records(steps, P).agg(F.sum("unallocated_parts"), F.sum("unallocated_energy")).first()
    whole = steps.agg(F.sum("produced"), F.sum("energy_delta"), F.sum(F.least("gap_s", F.lit(60)))).first()
    assert hourly[0] + gaps[0] == whole[0]
    assert hourly[1] + gaps[1] == pytest.approx(whole[1])
    assert hourly[2] == whole[2]


def test_meter_order_matches_walk(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 2]), seq, T0 + rng.randint(0, 60), rng.random() < 0.5, rng.choice([None, 0.0, 1.0, 2.0]))
            for seq in range(400)]
    df = spark.createDataFrame(rows, "machine_id BIGINT, seq BIGINT, obs_at BIGINT, standalone BOOLEAN, energy DOUBLE")
    got = {(r.machine_id, r.seq): (r.late, r.used) for r in meter_order(df, Params(chunk_seqs=29)).collect()}
    state = {}
    for m, seq, at, alone, kwh in rows:
        s = state.setdefault(m, {"snap": None, "seen": 0, "alone": None, "meter": None})
        if alone:
            late = at < max(s["seen"], s["meter"] or 0)
            used = not late and (kwh or 0) > 0
            if not late:
                s["seen"] = at
                s["alone"] = at if kwh is not None else s["alone"]
        else:
            late = s["snap"] is not None and at < s["snap"]
            used = not late and (kwh or 0) > 0 and (s["meter"] is None or at >= s["meter"]) and at != s["alone"]
            if not late:
                s["snap"] = at
                s["seen"] = max(s["seen"], at) if kwh is not None else s["seen"]
        if used:
            s["meter"] = at
        assert got[(m, seq)] == (late, used), (m, seq)
