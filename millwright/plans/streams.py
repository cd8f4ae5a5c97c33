"""Queries that run as Structured Streaming over several micro-batches and must equal the batch result."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millwright.functions.payload import fingerprint
from millwright.operators import admission
from millwright.operators.registry import registry_join
from millwright.operators.shifts import shift_calendar
from millwright.plans.admission import MSG, OUTCOME_SQL
from millwright.plans.alarms import AL_PACKETS_SQL, CRITICAL_SQL
from millwright.plans.catalog import query
from millwright.plans.dataflow import WAY
from millwright.plans.mapping import FLEET, MAPPED, SENT, SHIFTS_SQL, fleet, messages, registry, shifts, stamp
from millwright.plans.production import BOOKINGS_SQL, GAPS_SQL, HOURLY_SQL
from millwright.plans.signals import KWH_SQL, TELEMETRY_SQL, telemetry_columns
from millwright.session import checkpoint_dir, scratch_table
from millwright.sources.messages import stream_messages
from millwright.sources.versions import VersionedTable
from millwright.streaming import stateful
from millwright.streaming.dedup import without_copies
from millwright.streaming.machine import TABLES, MachineStream, live, machine_states
from millwright.streaming.ordered import sorted_streams
from millwright.streaming.stateful import use_rocksdb

PARTS = 3
_RUNS: dict[tuple, tuple[MachineStream, str]] = {}


def landed_steps(spark, d, root: str):
    """The packets as NDJSON in a few folders along their numbers; yields after each."""
    rows = messages(spark, d)
    end = rows.agg(F.max("seq")).first()[0] + 1
    for i in range(PARTS):
        rows.where((F.col("seq") >= end * i // PARTS) & (F.col("seq") < end * (i + 1) // PARTS)).write.json(os.path.join(root, "in", f"step={i}"))
        yield i


def run(spark, d, changes=(), tables=TABLES) -> tuple[MachineStream, str]:
    """Land the packets in a few steps; after each, the stream goes on from its checkpoint. ``changes``: what happens to
    the calendar's folder before each step."""
    key = (*stamp(spark, d, "events", "customer", "nation"), changes, tables)
    if key not in _RUNS:
        use_rocksdb(spark)
        root = os.path.join(checkpoint_dir(spark), f"stream-{os.urandom(6).hex()}")
        calendar, checkpoint = VersionedTable(os.path.join(root, "calendar")), os.path.join(root, "checkpoint")
        calendar.publish(shift_calendar(shifts(spark, d)))
        job = MachineStream(os.path.join(root, "tables"), registry(spark, d), calendar.pinned, SENT, tables=tables)
        for i in landed_steps(spark, d, root):
            if i < len(changes) and changes[i]:
                changes[i](spark, d, calendar)
            job.run(stream_messages(spark, os.path.join(root, "in", "*")), checkpoint)
        _RUNS[key] = (job, checkpoint)
    return _RUNS[key]


@query("stream_hourly", f"{WAY}, {BOOKINGS_SQL} SELECT * EXCLUDE (company_id) FROM ({HOURLY_SQL.format(where='')})")
def stream_hourly(spark, d):
    return run(spark, d)[0].hourly(spark).drop("company_id").withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("machine_stream", f"{WAY}, {GAPS_SQL} SELECT * EXCLUDE (reason) FROM gaps")
def machine_stream(spark, d):
    return run(spark, d)[0].read(spark, "gaps").drop("reason", "batch_id")


@query("exactly_once", f"{WAY}, {GAPS_SQL} SELECT count(*) AS gaps, CAST(sum(unallocated_parts) AS BIGINT) AS parts FROM gaps")
def exactly_once(spark, d):
    """A micro-batch written a second time, as after a lost commit, adds nothing."""
    job, _ = run(spark, d)
    job.write(scratch_table(spark.read.parquet(job.path("steps", PARTS - 1)), "again"), PARTS - 1)
    return job.read(spark, "gaps").agg(F.count("*").alias("gaps"), F.sum("unallocated_parts").alias("parts"))


@query("alarm_outbox", f"{MSG}, {OUTCOME_SQL}, {AL_PACKETS_SQL}, {CRITICAL_SQL} SELECT machine_id, alarm_key, started_seq, occurred_at, severity FROM ce")
def alarm_outbox(spark, d):
    """Critical events as they were written together with the periods they belong to."""
    return run(spark, d)[0].read(spark, "outbox").select("machine_id", "alarm_key", "started_seq", "occurred_at", "severity")


@query("stream_alarm_periods", f"""{MSG}, {OUTCOME_SQL}, {AL_PACKETS_SQL} SELECT machine_id, alarm_key, seq AS started_seq, started_at, severity, ended_at FROM tl WHERE kind = 'open'""")
def stream_alarm_periods(spark, d):
    return run(spark, d)[0].periods(spark).select("machine_id", "alarm_key", "started_seq", "started_at", "severity", "ended_at")


@query("stream_live_state", f"""{WAY} SELECT machine_id, max(seq) AS last_seq, max_by(machine_status, seq) FILTER (WHERE NOT standalone) AS status FROM ar GROUP BY 1
  HAVING count(*) FILTER (WHERE NOT standalone) > 0 AND max_by(recv_ms, seq) // 1000 > (SELECT max(recv_ms) // 1000 FROM ar) - 86400""")
def stream_live_state(spark, d):
    states = machine_states(spark, run(spark, d)[1])
    now = states.agg(F.max("recv_ms")).first()[0] // 1000
    return live(states, now, SENT).select("machine_id", "last_seq", "status")


@query("late_routing", f"{MSG}, {OUTCOME_SQL} SELECT seq, machine_id, obs_at, substring(outcome, 6) AS reason FROM oc WHERE outcome LIKE 'late%'")
def late_routing(spark, d):
    """Late packets with their payload: those whose text is that of the packet."""
    late = run(spark, d)[0].read(spark, "late").alias("l")
    sent = messages(spark, d).select("seq", F.col("payload").alias("sent"))
    return late.join(sent, "seq").where("payload = sent").select("seq", "machine_id", "obs_at", "reason")


@query("stream_meters", f"""{MSG}, {OUTCOME_SQL} SELECT seq, machine_id, obs_at AS read_at, standalone, {KWH_SQL} AS kwh_total, CAST(CASE WHEN NOT standalone THEN k END AS FLOAT) AS kw1
  FROM oc WHERE outcome IN ('accepted', 'late_stale', 'late_out_of_order')""")
def stream_meters(spark, d):
    """Meter rows of both lanes, late packets included."""
    return run(spark, d)[0].read(spark, "meters").select("seq", "machine_id", "read_at", "standalone", "kwh_total", "kw1")


@query("stream_telemetry", TELEMETRY_SQL.replace("@rows", "oc JOIN a USING (machine_id, company_id) WHERE NOT standalone AND outcome = 'accepted'").replace("a.company_id", "company_id"))
def stream_telemetry(spark, d):
    return telemetry_columns(run(spark, d)[0].read(spark, "telemetry").drop("batch_id"))


@query("stream_batch_stats", f"""{MSG}, {OUTCOME_SQL} SELECT count(*) AS "rows", count(*) FILTER (WHERE outcome LIKE 'late%') AS late_rows FROM oc WHERE outcome NOT IN ('invalid', 'unknown_machine', 'disconnected')""")
def stream_batch_stats(spark, d):
    return run(spark, d)[0].read(spark, "batches").agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))


@query("stream_metrics", f"""{WAY}, {GAPS_SQL}, pk AS (SELECT outcome, seq, (SELECT max(seq) + 1 FROM oc) AS n FROM oc),
  pb AS (SELECT outcome, seq, CASE WHEN seq < n // {PARTS} THEN 0 WHEN seq < n * 2 // {PARTS} THEN 1 ELSE 2 END AS batch_id FROM pk)
  SELECT batch_id, count(*) AS packets, count(*) FILTER (WHERE outcome = 'invalid') AS invalid, count(*) FILTER (WHERE outcome = 'unknown_machine') AS unknown_machine,
    count(*) FILTER (WHERE outcome = 'disconnected') AS disconnected, count(*) FILTER (WHERE outcome NOT IN ('invalid', 'unknown_machine', 'disconnected')) AS "rows",
    count(*) FILTER (WHERE outcome LIKE 'late%') AS late_rows, count(gaps.seq) AS gaps FROM pb LEFT JOIN gaps USING (seq) GROUP BY 1""")
def stream_metrics(spark, d):
    """What each micro-batch of the machine stream counted while it ran, and wrote."""
    return run(spark, d)[0].batch_stats(spark).select("batch_id", "packets", "invalid", "unknown_machine", "disconnected", "rows", "late_rows", "gaps")


def _early(spark, d, calendar: VersionedTable) -> None:
    """From now on every company works the night, and every second shift begins an hour early."""
    start = F.when(F.expr("id % 10 = 2"), "13:00").otherwise(F.col("start_time"))
    calendar.publish(shift_calendar(shifts(spark, d).withColumn("start_time", start).withColumn("is_active", F.expr("id % 10 < 4"))))


def _torn(spark, d, calendar: VersionedTable) -> None:
    """The next version loses a file before anybody reads it."""
    number = calendar.publish(shift_calendar(shifts(spark, d)).withColumn("start_s", F.lit(0)).repartition(3))
    path = spark._jvm.org.apache.hadoop.fs.Path(calendar.root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for v in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"version-{number}-*")) for s in fs.listStatus(v.getPath())]
    fs.delete(next(p for p in parts if p.getName().startswith("part-")), False)


_CHANGES = (None, _early, _torn)
_VERSIONS = f"""s AS (SELECT *, 1 AS v FROM s0 UNION ALL SELECT n_nationkey * 10 + n, CAST(n_nationkey AS BIGINT), CASE WHEN n = 2 THEN 46800 ELSE b END, e, 2
  FROM nation, (VALUES (1, 21600, 50400), (2, 50400, 79200), (3, 79200, 21600)) v(n, b, e))"""


@query("dim_refresh", f"{WAY.replace(SHIFTS_SQL, 's0' + SHIFTS_SQL[1:])}, {_VERSIONS}, {BOOKINGS_SQL.replace('WHERE s.company_id = p.company_id', f'WHERE s.company_id = p.company_id AND s.v = CASE WHEN p.seq < (SELECT max(seq) + 1 FROM p) // {PARTS} THEN 1 ELSE 2 END')} SELECT * EXCLUDE (company_id) FROM ({HOURLY_SQL.format(where='')})")
def dim_refresh(spark, d):
    """Hours of a stream whose shift calendar changes between micro-batches, and then is replaced by one that lost a file."""
    return run(spark, d, _CHANGES, ("hourly",))[0].hourly(spark).drop("company_id").withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("stream_dedup", f"""{MSG} SELECT seq, machine_id FROM q JOIN a USING (machine_id) WHERE depth_ok AND time_ok AND NOT repeated""")
def stream_dedup(spark, d):
    parsed = admission.parse(messages(spark, d)).where("envelope_ok").select(
        "seq", "api_key", "recv_ms", fingerprint(F.col("payload"), F.col("time_s").cast("long")).alias("fingerprint"))
    known = registry(spark, d).select("api_key", "machine_id", "company_id", "is_active")
    rows = registry_join(parsed, known).select("seq", "machine_id", "recv_ms", "fingerprint")
    return _through(spark, rows, "dedup", without_copies, "seq").select("seq", "machine_id")


@query("restart_state", f"""{WAY} SELECT machine_id, max(seq) AS last_seq, CAST(max_by(coalesce(g5.baseline, -1), seq) AS BIGINT) AS baseline,
  max_by(machine_status, seq) FILTER (WHERE NOT standalone) AS status, max_by(energy, seq) FILTER (WHERE energy > 0) AS meter FROM g5 GROUP BY 1""")
def restart_state(spark, d):
    """What the next start goes on from: the state store's row of every machine."""
    return machine_states(spark, run(spark, d)[1]).select("machine_id", "last_seq", F.coalesce("baseline", F.lit(-1).cast("long")).alias("baseline"), "status", "meter")


def _through(spark, rows, name, operator, time):
    """Land ``rows`` in two steps along ``time`` and run the stateful operator over each."""
    use_rocksdb(spark)
    root = os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")
    landed = scratch_table(rows, name)
    cut = landed.agg(((F.min(time) + F.max(time)) / 2).cast("long")).first()[0]
    out = os.path.join(root, "out")
    for i, part in enumerate((F.col(time) <= cut, F.col(time) > cut)):
        landed.where(part).write.parquet(os.path.join(root, "in", f"step={i}"))
        stream = operator(spark.readStream.schema(landed.schema).parquet(os.path.join(root, "in", "*")), MAPPED)
        with sorted_streams(spark):
            going = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start()
        going.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# the state goes from window to window of a plant: machines shown as late with their step and when last heard, and when a line was shown
LAG_SQL = """lw AS (SELECT plant_id, machine_id, recv_ms // 60000 * 60 AS window_start, count(*) FILTER (WHERE lag_ms > 10000) AS late_readings,
    max(lag_ms) FILTER (WHERE lag_ms > 10000) AS worst_ms, max(recv_ms) AS last_ms, arg_max(lag_ms <= 10000, seq) AS ends_on_time FROM f GROUP BY 1, 2, 3),
ws AS (SELECT plant_id, window_start, (window_start + 60) * 1000 AS now_ms, list({'m': machine_id, 'n': late_readings, 'worst': worst_ms,
    'step': (coalesce(worst_ms, 0) > 60000)::INT + (coalesce(worst_ms, 0) > 120000)::INT + (coalesce(worst_ms, 0) > 240000)::INT, 'heard': last_ms, 'well': ends_on_time}
    ORDER BY machine_id) AS seen, row_number() OVER (PARTITION BY plant_id ORDER BY window_start) AS rn FROM lw GROUP BY 1, 2),
walk AS (
  SELECT plant_id, 0::BIGINT AS rn, 0::BIGINT AS window_start, []::STRUCT(m BIGINT, step INT, heard BIGINT)[] AS shown, NULL::BIGINT AS told_ms,
    false AS fired, []::BIGINT[] AS late, 0::HUGEINT AS n, NULL::BIGINT AS worst, 0 AS step, []::BIGINT[] AS back FROM ws WHERE rn = 1
  UNION ALL
  SELECT plant_id, rn, window_start, kept, CASE WHEN len(back) > 0 AND len(kept) = 0 THEN now_ms WHEN fired THEN now_ms ELSE told_ms END, fired,
    list_transform(tardy, lambda r: r.m), list_sum(list_transform(tardy, lambda r: r.n)), worst, step, back
  FROM (SELECT *, list_filter(CASE WHEN fired THEN list_concat(list_filter(held, lambda s: NOT list_contains(list_transform(tardy, lambda r: r.m), s.m)),
      list_transform(tardy, lambda r: {'m': r.m, 'step': r.step, 'heard': r.heard})) ELSE held END, lambda s: NOT list_contains(back, s.m)) AS kept
    FROM (SELECT *, len(tardy) > 0 AND (len(known) < len(tardy) OR step > list_max(known) OR told_ms IS NULL OR now_ms - told_ms >= 900000) AS fired
      FROM (SELECT *, list_max(list_transform(tardy, lambda r: r.worst)) AS worst, list_max(list_transform(tardy, lambda r: r.step)) AS step,
          list_transform(list_filter(held, lambda s: list_contains(list_transform(tardy, lambda r: r.m), s.m)), lambda s: s.step) AS known,
          list_transform(list_filter(seen, lambda r: r.well AND list_contains(list_transform(held, lambda s: s.m), r.m)), lambda r: r.m) AS back
        FROM (SELECT x.*, w.told_ms, list_filter(x.seen, lambda r: r.n > 0) AS tardy,
            list_filter(list_transform(w.shown, lambda s: {'m': s.m, 'step': s.step, 'heard': coalesce(list_max(list_transform(list_filter(x.seen, lambda r: r.m = s.m), lambda r: r.heard)), s.heard)}),
              lambda s: x.now_ms - s.heard <= 86400000) AS held
          FROM walk w JOIN ws x ON x.plant_id = w.plant_id AND x.rn = w.rn + 1))))),
told AS (SELECT plant_id, window_start, 'late' AS kind, CASE WHEN step >= 2 THEN 'error' ELSE 'warn' END AS level, late AS ms, CAST(n AS BIGINT) AS late_readings,
    worst AS worst_ms FROM walk WHERE fired
  UNION ALL SELECT plant_id, window_start, 'recovered', 'info', back, 0, NULL FROM walk WHERE len(back) > 0)"""


@query("lag_alerts", f"""{FLEET.replace('WITH', 'WITH RECURSIVE', 1)}, {LAG_SQL}
  SELECT plant_id, window_start, kind, level, array_to_string(ms, ',') AS machines, late_readings, worst_ms FROM told""")
def lag_alerts_query(spark, d):
    rows = fleet(spark, d, "plant_id").select("plant_id", "machine_id", "seq", "recv_ms", "lag_ms")
    return _through(spark, stateful.machine_windows(rows, MAPPED), "alerts", stateful.lag_alerts, "window_start").withColumn(
        "machines", F.array_join("machines", ","))


IDENTITY_SQL = """n AS (SELECT machine_id, seq, recv_ms, 's' || (k // 50) AS identity, row_number() OVER (PARTITION BY machine_id ORDER BY seq) AS rn FROM f),
r AS (SELECT *, identity AS held, recv_ms AS at_ms, true AS written FROM n WHERE rn = 1
  UNION ALL SELECT x.machine_id, x.seq, x.recv_ms, x.identity, x.rn, CASE WHEN w THEN x.identity ELSE held END, CASE WHEN w THEN x.recv_ms ELSE at_ms END, w
  FROM (SELECT n.*, r.held, r.at_ms, n.identity <> r.held OR n.recv_ms - r.at_ms >= 3600000 AS w FROM r JOIN n ON n.machine_id = r.machine_id AND n.rn = r.rn + 1) x)"""


@query("identity_rate_limit", f"""{FLEET.replace('WITH', 'WITH RECURSIVE', 1)}, {IDENTITY_SQL} SELECT machine_id, seq, recv_ms, identity FROM r WHERE written""")
def identity_rate_limit(spark, d):
    rows = fleet(spark, d).select("machine_id", "seq", "recv_ms", F.expr("concat('s', k div 50)").alias("identity"))
    return _through(spark, rows, "identity", stateful.identity_writes, "seq")
