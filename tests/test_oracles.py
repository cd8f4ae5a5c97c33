"""Registered queries against their SQL on the smallest scale; MILLWRIGHT_ALL=1 runs every one."""

import math
import os

import pytest

from millwright.plans import load

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
CATALOG = load()
QUICK = ("shift_at", "unknown_machines", "parts_delta", "observation_gaps", "production_hourly", "canonical_keys", "arrival_order", "alarm_periods",
         "critical_events", "meter_merge", "lag_episodes", "late_windows", "identity_update", "replay_safe_commit", "range_guard", "quarantine_summary",
         "pipeline_readings", "pipeline_hourly", "priority_match", "priority_events", "alarm_lifecycle", "alarm_state_after", "alarm_notifications", "hourly_days", "meter_days", "dead_letters", "storable_rows", "stream_metrics", "lag_alerts", "identity_rate_limit", "bounded_entries")
NAMES = sorted(CATALOG.ORACLES) if os.environ.get("MILLWRIGHT_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = CATALOG.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    result = duck.execute(CATALOG.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())
    assert got == want
