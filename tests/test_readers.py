"""Readers of a packet: what costs the most is done once, and reads the same."""

from pyspark.sql import functions as F

from millwright.functions import battery
from millwright.functions.payload import canonical, depth_ok, fingerprint, object_of


def test_depth_takes_one_pass_over_the_payload(spark):
    assert str(depth_ok(F.col("p"), 12)).count("regexp_replace") == 1


def test_depth_of_empty_containers_and_marked_texts(spark):
    deep = lambda n, inner: '{"a":' + "[" * n + inner + "]" * n + "}"
    side = '{"a":[' + ",".join(['{"b":[]}'] * 20) + "]}"
    marked = '{"a":"' + '[{\\"' * 20 + '","b":[[1]]}'
    texts = {deep(11, "1"): True, deep(12, "1"): False, deep(11, "[]"): True, deep(11, "[ ]"): True, deep(11, "[{}]"): False, deep(11, '"]]"'): True,
             deep(12, '"]]"'): False, side: True, marked: True, '{"a":[[1],[2]],"b":' + "[" * 12 + "1" + "]" * 12 + "}": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r[0]: r[1] for r in rows.select("t", depth_ok(F.col("t"), 12)).collect()} == texts


def test_a_fingerprint_writes_its_fields_at_once(spark):
    written = str(fingerprint(F.col("p"), F.col("t")))
    assert written.count("to_json(transform") == 0 and written.count("sort_array") == 4  # with and without time, by value and as sent


def test_fingerprints_of_drifting_keys_missing_times_and_nested_order(spark):
    same = [['{"A":1,"b":{"y":1,"x":2.50}}', '{"b":{"x":2.5,"y":1.0},"a":1,"time":7}', '{" a ":1.0,"B":{"x":2.5,"y":1},"time":7}'],
            ['{"a":null,"b":{"y":1,"x":2.5}}'], ['{"a":"1","b":{"y":1,"x":2.5}}'], ['{"a":1,"b":{"y":1,"x":2.5},"time":"7"}'],
            ['{"a":"x.0}","b":"1.50,"}'], ['{"a":"x}","b":"1.5,"}'], ['{"a":1,"A":2}', '{"a":1}'], ['{"A":2,"B":{"y":1,"y":1}}'], ['{"a":2,"b":{"y":1}}']]
    rows = spark.createDataFrame([(i, t) for i, texts in enumerate(same) for t in texts], "i INT, t STRING")
    prints = rows.select("i", fingerprint(F.col("t"), F.lit(7).cast("long")).alias("f")).collect()
    assert all(r.f for r in prints) and len({(r.i, r.f) for r in prints}) == len({r.f for r in prints}) == len(same)


def test_keys_that_meet_keep_the_exact_spelling_else_the_first(spark):
    texts = {'{"B":1,"a":2}': {"b": "1", "a": "2"}, '{"B":1,"b":2}': {"b": "2"}, '{" B":1,"B":2}': {"b": "1"}, '{"":1," ":2,"c":3}': {"c": "3"}, '{"c":1,"c":2}': {"c": "2"}, "{}": {}, "[]": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r.t: r.m for r in rows.select("t", canonical(object_of(F.col("t"))).alias("m")).collect()} == texts


def test_battery_members_are_read_by_kind(spark):
    text = '{"x":{"raw":"8","low":"true","ABP":true,"INP":"0","EXP":0,"status":" a\\u0001b ","source":5},"y":{"raw":99999999999,"low":false,"status":" "}}'
    rows = spark.createDataFrame([(text,)], "t STRING").select(F.create_map(F.lit("acc_battery"), "t").alias("f"))
    got = rows.select(battery.encoder_batteries(F.col("f"))).first()[0]
    assert got["X"].asDict() == dict(low=True, raw=8, ABP=True, INP=False, EXP=False, status="a b", source=None)
    assert got["Y"].asDict() == dict(low=False, raw=None, ABP=False, INP=False, EXP=False, status=None, source=None)
