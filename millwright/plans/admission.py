"""Queries: envelope checks, lanes, order, duplicates and the outcome of every message."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millwright.functions.payload import canonical, depth_ok, fingerprint, object_of, staged
from millwright.operators import admission as ops
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED, MESSAGES_SQL, SENT, fleet, messages, registry
from millwright.session import checkpoint_dir, materialise
from millwright.sources.messages import read_messages

MSG = f"{FLEET}, {MESSAGES_SQL}"


def opened(spark, d):
    """Packets whose envelope holds an object, with canonical fields."""
    m = messages(spark, d).where(ops.topic_key(F.col("topic")).isNotNull() & ops.size_ok(F.col("payload")))
    return staged(m, fields=canonical(object_of(F.col("payload")))).where(F.col("fields").isNotNull())


@query("raw_messages", f"""{MSG} SELECT seq, CASE WHEN topic_ok THEN 'machines/k' || machine_id || '/telemetry'
  ELSE 'machines//telemetry' END AS topic, recv_ms FROM p""")
def raw_messages(spark, d):
    path = os.path.join(checkpoint_dir(spark), f"packets-{os.urandom(6).hex()}")
    messages(spark, d).write.option("compression", "gzip").json(path)
    return read_messages(spark, path).select("seq", "topic", "recv_ms")


@query("topic_filter", f"{MSG} SELECT seq, 'k' || machine_id AS api_key FROM p WHERE topic_ok")
def topic_filter(spark, d):
    m = messages(spark, d).select("seq", ops.topic_key(F.col("topic")).alias("api_key"))
    return m.where(F.col("api_key").isNotNull())


@query("payload_size", f"{MSG} SELECT seq, size_ok OR NOT object_ok AND event_seq % 101 = 0 AS size_ok FROM p")
def payload_size(spark, d):
    return messages(spark, d).select("seq", ops.size_ok(F.col("payload")).alias("size_ok"))


@query("json_object", f"{MSG} SELECT seq FROM q")
def json_object(spark, d):
    return opened(spark, d).select("seq")


@query("json_depth", f"{MSG} SELECT seq, depth_ok FROM q")
def json_depth(spark, d):
    return opened(spark, d).select("seq", depth_ok(F.col("payload"), MAPPED.max_depth).alias("depth_ok"))


@query("canonical_keys", f"""{MSG} SELECT seq, CASE WHEN NOT standalone THEN status_word END AS machine_status,
  CASE WHEN NOT standalone THEN mode END AS mode, '10.0.0.' || machine_id % 250 AS machine_ip FROM q""")
def canonical_keys(spark, d):
    f = F.col("fields")
    return opened(spark, d).select("seq", *[f[k].alias(k) for k in ("machine_status", "mode", "machine_ip")])


@query("energy_lane", f"{MSG} SELECT seq, standalone AND depth_ok AS is_energy FROM q")
def energy_lane(spark, d):
    return ops.parse(messages(spark, d)).where(F.col("fields").isNotNull()).select("seq", "is_energy")


@query("observation_time", f"{MSG} SELECT seq, obs_at FROM q WHERE depth_ok AND time_ok")
def observation_time(spark, d):
    return ops.parse(messages(spark, d)).where("envelope_ok").select("seq", F.col("time_s").cast("long").alias("obs_at"))


@query("valid_device_time", f"{MSG} SELECT seq, time_ok OR no_time AS time_ok FROM q WHERE depth_ok")
def valid_device_time(spark, d):
    parsed = ops.parse(messages(spark, d)).where(F.col("fields").isNotNull() & depth_ok(F.col("payload"), MAPPED.max_depth))
    return parsed.select("seq", ops.valid_device_time(F.col("time_s"), F.col("recv_ms")).alias("time_ok"))


@query("disconnected_filter", f"{MSG} SELECT seq, disconnected FROM q")
def disconnected_filter(spark, d):
    return opened(spark, d).select("seq", ops.is_disconnected(F.col("fields")).alias("disconnected"))


@query("stale_filter", f"{FLEET} SELECT seq, machine_id, device_time, lag_ms FROM f WHERE lag_ms > 300000")
def stale_filter(spark, d):
    return fleet(spark, d).where(ops.is_stale(F.col("lag_ms"))).select("seq", "machine_id", "device_time", "lag_ms")


@query("arrival_order", f"""{FLEET}, o AS (SELECT seq, machine_id, dt_ooo, max(dt_ooo) OVER (PARTITION BY machine_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM f)
  SELECT *, coalesce(dt_ooo < newest_before, false) AS out_of_order FROM o""")
def arrival_order(spark, d):
    return ops.arrival_order(fleet(spark, d).select("seq", "machine_id", "dt_ooo"), "dt_ooo", MAPPED)


# one group per distinct payload: a copy is equal unless its time comes from the receipt
SAME_SQL = "event_seq * 8 + CASE WHEN no_time THEN copy ELSE 0 END"


@query("fingerprint", f"""{MSG} SELECT min(seq) AS first_seq, count(*) AS copies FROM q WHERE depth_ok AND time_ok GROUP BY {SAME_SQL}""")
def fingerprint_groups(spark, d):
    parsed = ops.parse(messages(spark, d)).where("envelope_ok")
    prints = parsed.select("seq", fingerprint(F.col("payload"), F.col("time_s").cast("long")).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.min("seq").alias("first_seq"), F.count("*").alias("copies")).drop("fingerprint")


@query("dedup", f"""{MSG} SELECT seq, machine_id, NOT repeated AS is_first FROM q JOIN a USING (machine_id)
  WHERE depth_ok AND time_ok""")
def dedup(spark, d):
    from millwright.operators.registry import registry_join
    parsed = ops.parse(messages(spark, d)).where("envelope_ok").select(
        "seq", "api_key", "recv_ms", fingerprint(F.col("payload"), F.col("time_s").cast("long")).alias("fingerprint"))
    rows = materialise(registry_join(parsed, registry(spark, d).select(
        "api_key", "machine_id", "company_id", "is_active")).select("seq", "machine_id", "recv_ms", "fingerprint"))
    return ops.first_copies(rows, SENT).select("seq", "machine_id", "is_first")


METER_SQL = """mo1 AS (SELECT seq, machine_id, standalone, recv_s - CASE WHEN seq % 7 = 3 THEN 40000 ELSE seq % 4 END AS obs_at,
    CASE WHEN k % 19 > 0 THEN meter_kwh END AS energy FROM f),
mo2 AS (SELECT *, NOT standalone AND coalesce(obs_at < max(CASE WHEN NOT standalone THEN obs_at END) OVER w, false) AS late1
  FROM mo1 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mo3 AS (SELECT *, CASE WHEN standalone THEN coalesce(obs_at < max(CASE WHEN standalone OR (NOT late1 AND energy IS NOT NULL)
    THEN obs_at END) OVER w, false) ELSE late1 END AS late
  FROM mo2 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mo4 AS (SELECT *, last_value(CASE WHEN standalone AND NOT late AND energy IS NOT NULL THEN obs_at END IGNORE NULLS) OVER w AS alone_at
  FROM mo3 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mo5 AS (SELECT *, NOT late AND coalesce(energy > 0, false) AND (standalone OR coalesce(obs_at <> alone_at, true)) AS cand FROM mo4),
mo6 AS (SELECT *, cand AND (standalone OR coalesce(obs_at >= max(CASE WHEN cand THEN obs_at END) OVER w, true)) AS used
  FROM mo5 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("meter_order", f"{FLEET}, {METER_SQL} SELECT seq, machine_id, standalone, late, used FROM mo6")
def meter_order(spark, d):
    sent = F.col("recv_s") - F.when(F.col("seq") % 7 == 3, 40_000).otherwise(F.col("seq") % 4)
    rows = fleet(spark, d).select("seq", "machine_id", "standalone", sent.alias("obs_at"),
                                  F.when(F.col("k") % 19 > 0, F.col("meter_kwh")).alias("energy"))
    return ops.meter_order(rows, MAPPED).select("seq", "machine_id", "standalone", "late", "used")


OUTCOME_SQL = f"""oc1 AS (SELECT p.*, a.company_id, topic_ok AND size_ok AND object_ok AND depth_ok AND time_ok AS envelope_ok,
    a.machine_id IS NOT NULL AS known, p.recv_ms - obs_at * 1000 > 80000000 AS stale, {SAME_SQL} AS print FROM p LEFT JOIN a USING (machine_id)),
oc2 AS (SELECT * FROM oc1 WHERE envelope_ok AND known AND NOT disconnected AND NOT repeated AND NOT stale),
oc3 AS (SELECT *, NOT standalone AND coalesce(obs_at < max(CASE WHEN NOT standalone THEN obs_at END) OVER w, false) AS late1
  FROM oc2 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
oc4 AS (SELECT *, max(CASE WHEN standalone OR (NOT late1 AND has_kwh) THEN obs_at END) OVER w AS seen_at,
    last_value(CASE WHEN NOT standalone AND NOT late1 THEN {{'at': obs_at, 'print': print}} END IGNORE NULLS) OVER w AS snapshot
  FROM oc3 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
oc5 AS (SELECT *, CASE WHEN standalone THEN coalesce(obs_at < seen_at, false) ELSE late1 END AS late FROM oc4),
oc6 AS (SELECT seq, late, NOT late AND CASE WHEN standalone THEN coalesce(obs_at = seen_at AND print = last_value(CASE WHEN standalone AND NOT late THEN print END IGNORE NULLS) OVER w, false)
    ELSE coalesce(snapshot.at = obs_at AND snapshot.print = print, false) END AS unchanged
  FROM oc5 WINDOW w AS (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
oc AS (SELECT oc1.*, CASE WHEN NOT envelope_ok THEN 'invalid' WHEN NOT known THEN 'unknown_machine'
    WHEN NOT disconnected AND repeated THEN 'duplicate' WHEN disconnected THEN 'disconnected'
    WHEN stale THEN 'late_stale' WHEN late THEN 'late_out_of_order' WHEN unchanged THEN 'duplicate' ELSE 'accepted' END AS outcome
  FROM oc1 LEFT JOIN oc6 USING (seq))"""


@query("classify_outcome", f"""{MSG}, {OUTCOME_SQL} SELECT seq, outcome, CASE WHEN envelope_ok THEN obs_at END AS obs_at FROM oc""")
def classify_outcome(spark, d):
    return ops.classify(messages(spark, d), registry(spark, d), SENT).select("seq", "outcome", "obs_at")


@query("outcome_counts", f"{MSG}, {OUTCOME_SQL} SELECT outcome, count(*) AS messages FROM oc GROUP BY 1")
def outcome_counts(spark, d):
    return ops.outcome_counts(ops.classify(messages(spark, d), registry(spark, d), SENT))


@query("energy_counts", f"""{MSG}, {OUTCOME_SQL} SELECT count(*) FILTER (WHERE outcome = 'accepted' AND standalone) AS energy_accepted,
  count(*) FILTER (WHERE outcome IN ('late_stale', 'late_out_of_order')) AS energy_late_accepted FROM oc""")
def energy_counts(spark, d):
    return ops.energy_counts(ops.classify(messages(spark, d), registry(spark, d), SENT, with_readings=True))
