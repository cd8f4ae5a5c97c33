"""Packets are landed without shuffling their text, and read and walked at any length and number."""

import datetime
import glob
import os
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from millwright.functions.payload import depth_ok, fingerprint
from millwright.params import Params
from millwright.plans import load, mapping
from millwright.session import HUGE, checkpoint_dir
from millwright.streaming.machine import STEP_FIELDS, TOGETHER, MachineWalk


def events(spark, path):
    kinds = ("view", "click", "purchase", "signup", "error")
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), i % 5, kinds[i % 5], 1.5, f'{{"k": {i % 100}}}') for i in range(60)]
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(path, "events.parquet"))
    return str(path)


def test_only_narrow_rows_are_dealt(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(mapping, "scratch_table", lambda df, name: seen.append(df) or df)
    assert mapping.messages(spark, events(spark, tmp_path)).where("payload IS NOT NULL").count() == 60 + 2 + 3 * 4
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate explode") < plan.index("RoundRobinPartitioning")  # the texts are made after the exchange


def test_no_method_of_the_landing_is_too_long_for_the_jvm_to_compile(spark, tmp_path, monkeypatch):
    seen, before = [], spark.conf.get(HUGE)

    def written(df, name):
        seen.append(int(spark.conf.get(HUGE)))
        return df

    monkeypatch.setattr(mapping, "scratch_table", written)
    plan = mapping.messages(spark, events(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert seen == [8000] and spark.conf.get(HUGE) == before
    assert plan.count('"PowerData"') == 1  # a packet's body is written once, whatever becomes of it


def test_packets_land_compressed(spark, tmp_path):
    before = set(glob.glob(os.path.join(checkpoint_dir(spark).removeprefix("file:"), "packets-*", "*.json.gz")))
    rows = load().QUERIES["raw_messages"](spark, events(spark, tmp_path))
    assert rows.count() == 74 and rows.where("seq IS NULL OR topic IS NULL OR recv_ms IS NULL").count() == 0
    assert set(glob.glob(os.path.join(checkpoint_dir(spark).removeprefix("file:"), "packets-*", "*.json.gz"))) - before


def test_long_texts_have_a_fingerprint(spark):
    long = "y1.50" * 8_000
    rows = spark.createDataFrame([(1, f'{{"a": "{long}", "n": 1.50}}'), (2, f'{{"n": 1.5, "a": "{long}"}}'), (3, f'{{"n": 1.5, "a": "{long}0"}}')], "i INT, payload STRING")
    one, two, three = [r[0] for r in rows.select(fingerprint(F.col("payload"))).collect()]
    assert one == two and one != three


def test_depth_counts_values_not_marks(spark):
    deep = lambda n, inner: "[" * n + inner + "]" * n
    texts = {'{"a": [1, "x, [y", {"b": null}], "c": "q\\"{"}': True, f'{{"a": {deep(11, "1")}}}': True, f'{{"a": {deep(12, "1")}}}': False, f'{{"a": {deep(12, "")}}}': True,
             f'{{"a": {deep(12, " ")}}}': True, f'{{"a": {deep(13, "")}}}': False, '{"a": [{}, [], {"b": [2 , 3]}, "[[[[[[[[[[[["]}': True}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert {r[0]: r[1] for r in rows.select("t", depth_ok(F.col("t"), 12)).collect()} == texts


def test_a_machines_steps_leave_in_short_lists():
    walk, kept = MachineWalk(Params()), {}
    walk.held = SimpleNamespace(exists=lambda: False, update=lambda v: kept.update(held=v))
    walk.copies = SimpleNamespace(iterator=lambda: iter(()), updateValue=lambda k, v: kept.update({k: v}), removeKey=lambda k: None)
    at = 1_704_100_000
    frame = pd.DataFrame([dict(machine_id=1, seq=i, company_id=3, obs_at=at + 60 * i, recv_ms=(at + 60 * i) * 1000 + 5, is_energy=False, energy=float(i), fingerprint=f"h{i}",
                               machine_status="RUN", mode="AUTO", parts_count=float(i) if i % 2 else None, alarms=None, payload="{}") for i in range(150)])
    lists = [steps for out in walk.handleInputRows((1,), iter([frame]), None) for steps in out["steps"]]
    assert max(map(len, lists)) == TOGETHER and [s["seq"] for steps in lists for s in steps] == [*range(150)]
    assert all(list(s) == STEP_FIELDS for steps in lists for s in steps) and lists[-1][-1]["prev_at"] == at + 60 * 148
