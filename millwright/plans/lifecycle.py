"""Queries: stored alarm periods carried on by later transitions, packets late and out of order included.

Periods are those of the readings up to ``SPLIT``; the readings after it, with shifted device times, are the transitions.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from millwright.operators import alarms as ops
from millwright.operators import lifecycle
from millwright.plans.alarms import AL_SQL, CLASS_SQL, alarm_readings
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED
from millwright.session import checkpoint_dir, materialise
from millwright.sources.sinks import read_alarm_state, write_alarm_state

SPLIT = 1_705_320_000_000  # 15 January 2024, noon


def _readings(spark, d):
    """Alarm readings whose servo alarms are battery codes."""
    key = lambda a: F.when(F.startswith(a["alarm_key"], F.lit("SV")), F.concat(
        F.lit("FANUC_ACC_SV"), F.substring(a["alarm_key"], 6, 1), F.lit("_LOW"))).otherwise(a["alarm_key"])
    return alarm_readings(spark, d).withColumn("alarms", F.transform("alarms", lambda a: F.struct(key(a).alias("alarm_key"), a["severity"].alias("severity"))))


def stored(spark, d):
    """The periods on record; every third has no observation of its own."""
    timeline = ops.alarm_timeline(materialise(ops.alarm_events(ops.alarm_diff(_readings(spark, d).where(F.col("recv_ms") < SPLIT), MAPPED))), MAPPED)
    seen = F.col("started_seq") % 3 != 0
    return ops.alarm_periods(timeline).select(
        "*", F.when(seen, F.col("started_at")).alias("observed_at"), F.when(seen, F.col("started_recv_ms")).alias("observed_recv_ms"),
        F.col("started_at").alias("priority_changed_at"), F.lit(None).cast("bigint").alias("continuity_at"))


def transitions(spark, d):
    way = F.col("seq") % 5
    at = F.when(way == 0, F.col("obs_at") - 259_200).when(way == 1, F.expr("obs_at div 43200 * 43200")).otherwise(F.col("obs_at"))
    clears = F.when(F.col("machine_id") % 2 == 0, F.array(F.lit("FANUC_ACC_SV1_LOW"))).otherwise(F.array().cast("array<string>"))
    late = _readings(spark, d).where(F.col("recv_ms") >= SPLIT).select(
        "company_id", "machine_id", "seq", at.alias("obs_at"), "recv_ms", "alarms", (F.col("machine_id") % 3 > 0).alias("preserve_battery"), clears.alias("battery_clears"))
    return ops.alarm_diff(late, MAPPED)


def carried_on(spark, d):
    periods = materialise(stored(spark, d))
    return periods, materialise(lifecycle.alarm_lifecycle(lifecycle.alarm_steps(transitions(spark, d), periods), periods, MAPPED))


_KEYED = AL_SQL.replace("'SV0' || (400 + k % 2)", "'FANUC_ACC_SV' || (k % 2) || '_LOW'")
_OLD = _KEYED.replace("FROM f)", f"FROM f WHERE recv_ms < {SPLIT})", 1)
_NEW = re.sub(r"\b(al0|al|ev|tl)\b", r"n_\1", _KEYED).replace(
    " seq, obs_at, ", " seq, CASE seq % 5 WHEN 0 THEN obs_at - 259200 WHEN 1 THEN obs_at // 43200 * 43200 ELSE obs_at END AS obs_at, ", 1).replace(
    "FROM f)", f"FROM f WHERE recv_ms >= {SPLIT})", 1)
_HELD = "machine_id % 3 > 0 AND alarm_key LIKE 'FANUC%' AND NOT (machine_id % 2 = 0 AND alarm_key = 'FANUC_ACC_SV1_LOW')"
# the walk row by row: the n-th step of every key at a time
LIFE_SQL = f"""{FLEET.replace('WITH', 'WITH RECURSIVE', 1)}, {_OLD}, {_NEW},
pd AS (SELECT company_id, machine_id, alarm_key, severity, seq AS started_seq, started_at, ended_at, recv_ms AS started_recv, ended_recv_ms AS ended_recv,
    CASE WHEN seq % 3 <> 0 THEN started_at END AS observed_at, CASE WHEN seq % 3 <> 0 THEN recv_ms END AS observed_recv FROM tl WHERE kind = 'open'),
kp AS (SELECT * FROM n_al0 WHERE rn = 1),
kk AS (SELECT DISTINCT machine_id, alarm_key FROM (SELECT machine_id, alarm_key FROM pd WHERE ended_at IS NULL UNION ALL SELECT machine_id, alarm_key FROM n_ev WHERE kind = 'open')),
sp AS (SELECT machine_id, company_id, alarm_key, seq, obs_at, recv_ms, kind, severity, CASE kind WHEN 'close' THEN 0 WHEN 'open' THEN 2 ELSE 3 END AS phase
    FROM n_ev WHERE kind <> 'close' OR NOT ({_HELD})
  UNION ALL SELECT machine_id, company_id, alarm_key, seq, obs_at, recv_ms, 'close', NULL, 0 FROM kp JOIN kk USING (machine_id)
    WHERE NOT ({_HELD}) AND NOT EXISTS (SELECT 1 FROM n_al a WHERE a.seq = kp.seq AND a.machine_id = kp.machine_id AND a.alarm_key = kk.alarm_key)
  UNION ALL SELECT machine_id, company_id, alarm_key, seq, obs_at, recv_ms, 'confirm', NULL, 1 FROM n_al WHERE rn = 1),
st AS (SELECT *, row_number() OVER (PARTITION BY machine_id, alarm_key ORDER BY seq, phase) AS n,
    obs_at * 100000000000000::HUGEINT + recv_ms AS t FROM sp),
fl AS (SELECT machine_id, alarm_key, max(greatest(started_at * 100000000000000::HUGEINT + started_recv, coalesce(ended_at * 100000000000000::HUGEINT + ended_recv, 0))) AS bar
    FROM pd GROUP BY 1, 2),
op AS (SELECT * FROM pd WHERE ended_at IS NULL),
wk AS (SELECT k.machine_id, k.alarm_key, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS effect, NULL::VARCHAR AS severity_before, op.started_seq IS NOT NULL AS is_open,
    coalesce(coalesce(op.observed_at, op.started_at) * 100000000000000::HUGEINT + coalesce(op.observed_recv, 0), 0) AS t, coalesce(bar, 0) AS bar,
    op.severity, op.started_at, op.started_seq
  FROM (SELECT DISTINCT machine_id, alarm_key FROM st) k LEFT JOIN fl USING (machine_id, alarm_key) LEFT JOIN op USING (machine_id, alarm_key)
  UNION ALL SELECT machine_id, alarm_key, n, seq, kind, e, CASE WHEN e IS NOT NULL THEN was END, CASE e WHEN 'opened' THEN true WHEN 'closed' THEN false ELSE was_open END,
    CASE WHEN e IN ('opened', 'observed') THEN st_t ELSE t END, CASE WHEN e IN ('opened', 'closed') THEN greatest(bar, st_t) ELSE bar END,
    CASE WHEN e IN ('opened', 'observed') THEN now WHEN e = 'closed' THEN NULL ELSE was END,
    CASE WHEN e = 'opened' THEN step_at WHEN e IS NULL AND NOT was_open THEN NULL ELSE started_at END, CASE WHEN e = 'opened' THEN seq WHEN e IS NULL AND NOT was_open THEN NULL ELSE started_seq END
  FROM (SELECT st.machine_id, st.alarm_key, st.n, st.seq, st.kind, st.obs_at AS step_at, st.t AS st_t, st.severity AS now, wk.severity AS was, wk.is_open AS was_open, wk.t, wk.bar,
      wk.started_at, wk.started_seq,
      CASE WHEN st.kind = 'confirm' THEN CASE WHEN wk.is_open AND wk.started_at <= st.obs_at THEN 'confirmed' END
        WHEN st.kind = 'close' THEN CASE WHEN wk.is_open AND st.t >= wk.t THEN 'closed' END
        WHEN wk.is_open THEN CASE WHEN st.t > wk.t THEN 'observed' END
        WHEN st.kind = 'open' AND st.t > wk.bar THEN 'opened' END AS e
    FROM wk JOIN st ON st.machine_id = wk.machine_id AND st.alarm_key = wk.alarm_key AND st.n = wk.n + 1) x),
lf AS (SELECT wk.machine_id, wk.alarm_key, wk.seq, wk.kind, wk.effect, wk.severity_before, CASE WHEN effect IS NOT NULL THEN wk.started_seq END AS started_seq,
    CASE WHEN effect IS NOT NULL THEN wk.started_at END AS started_at, st.severity, st.obs_at, st.recv_ms,
    effect = 'observed' AND {CLASS_SQL.format('st.severity')} <> {CLASS_SQL.format('wk.severity_before')} AS changed
  FROM wk JOIN st USING (machine_id, alarm_key, n))"""
PERIODS_AFTER_SQL = f"""{LIFE_SQL},
mv AS (SELECT machine_id, alarm_key, started_seq, arg_max(severity, seq) FILTER (WHERE effect IN ('opened', 'observed')) AS severity,
    arg_max(obs_at, seq) FILTER (WHERE effect IN ('opened', 'observed')) AS observed_at, max(obs_at) FILTER (WHERE effect = 'closed') AS ended_at,
    max(obs_at) FILTER (WHERE effect = 'confirmed') AS continuity_at, arg_max(obs_at, seq) FILTER (WHERE effect = 'opened' OR changed) AS priority_changed_at,
    max(obs_at) FILTER (WHERE effect = 'opened') AS started_at FROM lf WHERE effect IS NOT NULL GROUP BY 1, 2, 3)
SELECT machine_id, alarm_key, started_seq, coalesce(pd.started_at, mv.started_at) AS started_at, coalesce(mv.severity, pd.severity) AS severity,
  coalesce(mv.observed_at, pd.observed_at) AS observed_at, coalesce(mv.ended_at, pd.ended_at) AS ended_at,
  coalesce(mv.priority_changed_at, pd.started_at) AS priority_changed_at, mv.continuity_at
FROM pd FULL JOIN mv USING (machine_id, alarm_key, started_seq)"""


@query("alarm_lifecycle", f"{LIFE_SQL} SELECT machine_id, alarm_key, seq, kind, effect, severity_before, started_seq, changed FROM lf")
def alarm_lifecycle(spark, d):
    return carried_on(spark, d)[1].select("machine_id", "alarm_key", "seq", "kind", "effect", "severity_before", "started_seq", "changed")


@query("alarm_state_after", PERIODS_AFTER_SQL)
def alarm_state_after(spark, d):
    """The period table after two batches, written and read back."""
    periods, life = carried_on(spark, d)
    path = os.path.join(checkpoint_dir(spark), f"alarm-state-{os.urandom(6).hex()}")
    write_alarm_state(periods, lifecycle.notifications(life).limit(0), path, 0)
    before = read_alarm_state(spark, path)[0].where(F.col("ended_at").isNull())
    write_alarm_state(lifecycle.periods_after(before, life), lifecycle.notifications(life), path, 1)
    return read_alarm_state(spark, path)[0].select(
        "machine_id", "alarm_key", "started_seq", "started_at", "severity", "observed_at", "ended_at", "priority_changed_at", "continuity_at")


@query("alarm_notifications", f"""{LIFE_SQL} SELECT machine_id, alarm_key, started_seq, obs_at AS occurred_at, arg_min(severity, seq) AS severity FROM lf
  WHERE (effect = 'opened' OR changed) AND {CLASS_SQL.format('severity')} = 'critical' GROUP BY 1, 2, 3, 4""")
def alarm_notifications(spark, d):
    return lifecycle.notifications(carried_on(spark, d)[1]).select("machine_id", "alarm_key", "started_seq", "occurred_at", "severity")
