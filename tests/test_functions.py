"""Readers and texts on known values."""

import json

import pytest
from pyspark.sql import functions as F

from millwright.functions import alarm_text, battery, meter, numbers
from millwright.functions.alarm_entries import active_alarms, is_alarming
from millwright.functions.payload import canonical, depth_ok, fingerprint, object_of, staged
from millwright.operators import quality
from millwright.operators.meters import merge_observations, meter_merge, with_mask


def one(spark, column, **values):
    schema = ", ".join(f"{k} STRING" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("text,expected", [
    ("12 rpm", 12.0), ("1,5", 1.5), ("-3.5x", -3.5), ("true", None), ("1e999", None), ("", None), (".5", 0.5), ("1,2,3", 1.2)])
def test_lenient(spark, text, expected):
    assert one(spark, numbers.lenient_number(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text,unit,given,expected", [
    ("110.8 kWh", None, False, 110.8), ("955Wh", None, False, 0.955), ("2 MWh", None, False, 2000.0), ("2 mWh", None, False, None),
    ("5", "Wh", True, 0.005), ("5 kWh", "Wh", True, None), ("5", None, True, None), ("-1", None, False, None), ("1e-400", None, False, 0.0),
    ("5 kW", None, False, None), ("1,5", "kWh", True, 1.5), ("5 kWh x", None, False, None)])
def test_energy(spark, text, unit, given, expected):
    assert one(spark, numbers.energy_quantity(F.col("t"), F.col("u"), given), t=text, u=unit) == expected


def test_power_keeps_sign(spark):
    assert one(spark, numbers.power_quantity(F.col("t")), t="-955 W") == -0.955


@pytest.mark.parametrize("payload,expected", [
    ('{"A":1,"a":2," B ":3}', {"a": "2", "b": "3"}), ('{"a":2,"A":1}', {"a": "2"}), ('{"B ":1,"b ":2}', {"b": "1"}), ('{" ":1,"c":null}', {"c": None}),
    ('{"a":1} x', None), ("[1]", None), ("3", None), ('{"a":1},{"b":2}', None), ("null", None)])
def test_canonical(spark, payload, expected):
    assert one(spark, canonical(object_of(F.col("p"))), p=payload) == expected


def nested(n):
    return '{"a":' + "[" * n + "]" * n + "}"


@pytest.mark.parametrize("payload,ok", [
    (nested(12), True), (nested(13), False), ('{"a":' + "[" * 11 + "1" + "]" * 11 + "}", True), ('{"a":' + "[" * 12 + '"]"' + "]" * 12 + "}", False),
    ('{"s":"' + "[" * 40 + '\\"{"}', True)])
def test_depth(spark, payload, ok):
    assert one(spark, depth_ok(F.col("p"), 12), p=payload) is ok


def test_fingerprint_ignores_order_and_key_case_only(spark):
    texts = ['{"time":1,"b":{"y":1,"x":[1,2]}}', '{"B":{"x":[1,2],"y":1},"time":1}', '{"time":1,"b":{"y":1,"x":[2,1]}}', '{"b":{"y":1,"x":[1,2]}}']
    df = spark.createDataFrame([(t,) for t in texts], "p STRING")
    prints = [r[0] for r in df.select(fingerprint(F.col("p"), F.lit(1).cast("long"))).collect()]
    assert prints[0] == prints[1] == prints[3] != prints[2]


def alarms(spark, payload):
    df = staged(spark.createDataFrame([(json.dumps(payload),)], "p STRING"), fields=canonical(object_of(F.col("p"))))
    row = df.select(is_alarming(F.col("fields")).alias("on"), active_alarms(F.col("fields"), is_alarming(F.col("fields"))).alias("a")).first()
    return row.on, [tuple(x) for x in row.a]


def test_alarm_entries(spark):
    assert alarms(spark, {"stat_alarm": True}) == (False, [])
    assert alarms(spark, {"stat_alarm": 1}) == (True, [(None, None, None, None)])
    on, found = alarms(spark, {"pmc_alarm": {"exist": 1, "alarms": [
        {"number": 1046, "type": 15, "axis": 0, "message": "M06 TIMEOUT"}, {"number": 401, "type": 6, "axis": 2, "message": "VRDY"}, "EX1002",
        {"code": "EX1046"}, {"x": 1}, [1]]}})
    assert on and found == [("EX1046", "M06 TIMEOUT", "M06 TIMEOUT", None), ("SV0401", "VRDY", "VRDY (axis 2)", "CRITICAL"), ("EX1002", None, None, None)]
    assert alarms(spark, {"stat_emergency": 1}) == (True, [(None, "EMERGENCY STOP", None, "CRITICAL")])
    assert alarms(spark, {"machine_status": "alarm", "alarm_code": " A1 ", "alarm_name": "n"})[1] == [("A1", "n", None, None)]


def test_long_names_keep_apart(spark):
    texts = ["x" * 60 + "1", "x" * 60 + "2"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    fields = alarm_text.alarm_fields(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(" low "))
    rows = df.select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert len({r.alarm_key for r in rows}) == 2 and all(len(r.alarm_key) == 50 and r.severity == "LOW" for r in rows)
    assert rows[0].message == "Alarm type: " + texts[0]


@pytest.mark.parametrize("state,expected", [
    ({"raw": 8}, (True, True, False, False)), ({"low": False}, (False, False, False, False)), ({"raw": 0, "ABP": 1}, (True, True, False, False)),
    ({"low": True}, (True, None, None, None)), ({"raw": "x"}, (None, None, None, None))])
def test_battery_bits(spark, state, expected):
    df = spark.createDataFrame([(json.dumps({"acc_battery": {"x": state}}),)], "p STRING")
    got = df.select(battery.encoder_batteries(object_of(F.col("p")))).first()[0]["X"]
    assert (got.low, got.ABP, got.INP, got.EXP) == expected


def test_meter_columns(spark):
    assert len(meter.NAMES) == 52
    block = {"PowerData": {"Voltage_V1N": -1, "Total_kW": "-0.73", "PF1": -0.9, "Frequency": 1e39, "Auxiliary_Interrupts": 3e9, "Run_Hour": "5 h", "kW1": 2},
             "Energy": "110.8 kWh"}
    df = staged(spark.createDataFrame([(json.dumps(block),)], "p STRING"), fields=canonical(object_of(F.col("p"))))
    df = staged(df, power=meter.power_block(F.col("fields")), energy_data=meter.energy_block(F.col("fields")))
    df = staged(df, **meter.meter_columns(F.col("fields"), F.col("power"), F.col("energy_data")))
    got = df.select(*[c.alias(n) for n, c in meter.meter_fields().items()]).first().asDict()
    found = {k: round(v, 3) for k, v in got.items() if v is not None}
    assert found == {"kw_total": -0.73, "pf1": -0.9, "kw1": 2.0, "kwh_total": 110.8}


def test_meter_merge_in_batches_equals_one_merge(spark):
    import random
    rng, fields = random.Random(2), ("kw1", "kwh_total")
    rows = [(rng.randint(1, 3), rng.randint(1, 4), rng.choice([7, 7, 8, None]), seq, rng.random() < 0.4, rng.choice([None, 1.0, 2.0]), rng.choice([None, 5.0, 6.0]))
            for seq in range(200)]
    schema = "machine_id BIGINT, read_at BIGINT, company_id BIGINT, seq BIGINT, standalone BOOLEAN, kw1 DOUBLE, kwh_total DOUBLE"
    table = {}
    for m, at, company, seq, alone, *values in rows:
        row = table.setdefault((m, at), [company, False, {}, set()])
        if row[0] != company:
            continue
        row[1] |= alone
        for name, v in zip(fields, values):
            if v is not None and (alone or name not in row[3]):
                row[2][name] = v
                row[3] |= {name} if alone else set()
    expected = {k: (c, s, v.get("kw1"), v.get("kwh_total"), sorted(f)) for k, (c, s, v, f) in table.items()}
    df = spark.createDataFrame(rows, schema)
    shape = lambda out: {(r.machine_id, r.read_at): (r.company_id, r.standalone, r.kw1, r.kwh_total, list(r.standalone_fields)) for r in out.collect()}
    assert shape(merge_observations(with_mask(df, fields), fields)) == expected
    first = merge_observations(with_mask(df.where("seq < 90"), fields), fields)
    assert shape(meter_merge(first, df.where("seq >= 90"), fields)) == expected


def test_quarantine_never_shows_values(spark):
    line = json.dumps({"reason": "x", "code": "22001", "stage": "a b", "record": {"s": 7, "r": {"machine_id": "4", "mode": "secret"},
                                                                                 "a": {"opens": [{"alarm_code": "ü" * 60}]}}})
    df = spark.createDataFrame([(0, line), (1, "{"), (2, " "), (3, line + " tail")], "pos BIGINT, value STRING")
    parsed = quality.parse_quarantine(df)
    row = quality.quarantine_summary(parsed).first()
    assert (row.sequence, row.machine_id, row.reason, row.sqlstate, row.stage) == (7, 4, "unclassified", "22001", None)
    assert [(t.column, t.characters) for t in row.text_fields] == [("mode", 6), ("alarm_code", 60)] and "secret" not in str(row)
    assert {r.state: r.lines for r in quality.quarantine_counts(parsed).collect()} == {"record": 1, "malformed": 2}
