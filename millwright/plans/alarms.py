"""Queries: alarm text, alarm state, periods, events, batteries, and matching against stored periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import alarm_text, battery
from millwright.functions.alarm_entries import active_alarms, is_alarming
from millwright.functions.payload import staged
from millwright.operators import alarms as ops
from millwright.operators.shifts import shift_calendar, with_shift_at
from millwright.plans.admission import MSG, opened
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED, READINGS_SQL, fleet, shifts, table
from millwright.plans.production import SHIFT_AT_SQL
from millwright.session import materialise


def alarm_readings(spark, d):
    """Readings with their alarms: an error carries two codes, every fifth k one."""
    ex = F.struct(F.concat(F.lit("EX"), 1000 + F.col("k") % 3).alias("alarm_key"),
                  F.when(F.col("k") % 2 == 0, "LOW").otherwise("FATAL").alias("severity"))
    sv = F.struct(F.concat(F.lit("SV0"), 400 + F.col("k") % 2).alias("alarm_key"), F.lit("CRITICAL").alias("severity"))
    alarms = F.when(F.col("event_type") == "error", F.array(ex, sv)).when(F.col("k") % 5 == 0, F.array(ex)).otherwise(
        F.array().cast("array<struct<alarm_key:string,severity:string>>"))
    return fleet(spark, d).select("company_id", "machine_id", "seq", "obs_at", "recv_ms", alarms.alias("alarms"))


def timeline(spark, d):
    return ops.alarm_timeline(materialise(ops.alarm_events(ops.alarm_diff(alarm_readings(spark, d), MAPPED))), MAPPED)


EVENTS_SQL = """ev AS (
  SELECT n.company_id, n.machine_id, n.seq, n.obs_at, n.recv_ms, n.alarm_key, CASE WHEN o.seq IS NULL THEN 'open' ELSE 'severity' END AS kind,
    n.severity FROM al n LEFT JOIN al o ON o.machine_id = n.machine_id AND o.rn = n.rn - 1 AND o.alarm_key = n.alarm_key
    WHERE o.seq IS NULL OR o.severity <> n.severity
  UNION ALL SELECT r.company_id, r.machine_id, r.seq, r.obs_at, r.recv_ms, o.alarm_key, 'close', NULL
    FROM al0 r JOIN al o ON o.machine_id = r.machine_id AND o.rn = r.rn - 1
    WHERE NOT EXISTS (SELECT 1 FROM al n WHERE n.machine_id = r.machine_id AND n.rn = r.rn AND n.alarm_key = o.alarm_key)),
tl AS (SELECT *, max(CASE WHEN kind = 'open' THEN seq END) OVER u AS started_seq,
    max(CASE WHEN kind = 'open' THEN obs_at END) OVER u AS started_at,
    first_value(CASE WHEN kind = 'close' THEN obs_at END IGNORE NULLS) OVER d AS ended_at,
    first_value(CASE WHEN kind = 'close' THEN recv_ms END IGNORE NULLS) OVER d AS ended_recv_ms,
    last_value(severity IGNORE NULLS) OVER b AS severity_before
  FROM ev WINDOW u AS (PARTITION BY machine_id, alarm_key ORDER BY seq),
    d AS (PARTITION BY machine_id, alarm_key ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    b AS (PARTITION BY machine_id, alarm_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
AL_SQL = f"""al0 AS (SELECT company_id, machine_id, seq, obs_at, recv_ms, k, event_type,
    row_number() OVER (PARTITION BY machine_id ORDER BY seq) AS rn FROM f),
al AS (SELECT *, 'EX' || (1000 + k % 3) AS alarm_key, CASE WHEN k % 2 = 0 THEN 'LOW' ELSE 'FATAL' END AS severity FROM al0
    WHERE event_type = 'error' OR k % 5 = 0
  UNION ALL SELECT *, 'SV0' || (400 + k % 2), 'CRITICAL' FROM al0 WHERE event_type = 'error'),
{EVENTS_SQL}"""
# the same from packets: accepted snapshots and the alarms their payloads hold
AL_PACKETS_SQL = f"""al0 AS (SELECT company_id, machine_id, seq, obs_at, recv_ms, k, event_type,
    row_number() OVER (PARTITION BY machine_id ORDER BY seq) AS rn FROM oc WHERE outcome = 'accepted' AND NOT standalone),
al AS (SELECT *, 'EX' || (1000 + k % 3) AS alarm_key, CASE WHEN k % 10 = 0 THEN 'CRITICAL' ELSE 'NORMAL' END AS severity FROM al0 WHERE event_type = 'error'
  UNION ALL SELECT *, 'SV0' || (400 + k % 2), 'CRITICAL' FROM al0 WHERE event_type = 'error'
  UNION ALL SELECT *, CAST(k % 4 AS VARCHAR), 'NORMAL' FROM al0 WHERE event_type = 'error'
  UNION ALL SELECT *, 'UNSPECIFIED', 'NORMAL' FROM al0 WHERE event_type <> 'error' AND k % 9 = 0),
{EVENTS_SQL}"""
AL = f"{FLEET}, {AL_SQL}"
CLASS_SQL = ("CASE WHEN upper(trim({0})) IN ('CRITICAL','FATAL','EMERGENCY') THEN 'critical' WHEN upper(trim({0})) IN "
             "('INFO','INFORMATION','INFORMATIONAL','LOW','MESSAGE') THEN 'info' ELSE 'noncritical' END")


# from packets: what their payloads list
STATE_SQL = """al AS (SELECT seq, 'EX' || (1000 + k % 3) AS alarm_key, CASE WHEN k % 10 = 0 THEN 'CRITICAL' ELSE 'NORMAL' END AS severity FROM q WHERE NOT standalone AND event_type = 'error'
  UNION ALL SELECT seq, 'SV0' || (400 + k % 2), 'CRITICAL' FROM q WHERE NOT standalone AND event_type = 'error'
  UNION ALL SELECT seq, CAST(k % 4 AS VARCHAR), 'NORMAL' FROM q WHERE NOT standalone AND event_type = 'error'
  UNION ALL SELECT seq, 'UNSPECIFIED', 'NORMAL' FROM q WHERE NOT standalone AND event_type <> 'error' AND k % 9 = 0)"""


@query("alarm_state_of_reading", f"""{MSG}, {STATE_SQL} SELECT seq, string_agg(alarm_key, ',' ORDER BY alarm_key) AS alarm_keys,
  string_agg(alarm_key || '=' || severity, ',' ORDER BY alarm_key) AS severities FROM al GROUP BY 1""")
def alarm_state_of_reading(spark, d):
    listed = ops.alarm_state(opened(spark, d)).where(F.size("alarms") > 0).select("seq", F.array_sort("alarms").alias("alarms"))
    pair = F.transform("alarms", lambda a: F.concat(a["alarm_key"], F.lit("="), a["severity"]))
    return listed.select("seq", F.array_join(F.transform("alarms", lambda a: a["alarm_key"]), ",").alias("alarm_keys"),
                         F.array_join(pair, ",").alias("severities"))


@query("alarm_diff", f"{AL} SELECT seq, machine_id, alarm_key, kind, severity FROM ev")
def alarm_diff(spark, d):
    return ops.alarm_events(ops.alarm_diff(alarm_readings(spark, d), MAPPED)).select(
        "seq", "machine_id", "alarm_key", "kind", "severity")


@query("alarm_periods", f"""{AL} SELECT seq AS started_seq, machine_id, alarm_key, severity, started_at, ended_at,
  CAST({SHIFT_AT_SQL.format(c='tl.company_id', t='tl.started_at')} AS BIGINT) AS shift_id FROM tl WHERE kind = 'open'""")
def alarm_periods(spark, d):
    periods = ops.alarm_periods(timeline(spark, d))
    return with_shift_at(periods, shift_calendar(shifts(spark, d)), "started_at").select(
        "started_seq", "machine_id", "alarm_key", "severity", "started_at", "ended_at", "shift_id")


@query("severity_changes", f"""{AL} SELECT machine_id, alarm_key, seq, obs_at, started_at, severity_before, severity,
  CASE WHEN {CLASS_SQL.format('severity')} <> {CLASS_SQL.format('severity_before')} THEN obs_at END AS priority_changed_at
  FROM tl WHERE kind = 'severity'""")
def severity_changes(spark, d):
    return ops.severity_changes(timeline(spark, d)).drop("company_id")


CRITICAL_SQL = f"""ce AS (SELECT DISTINCT company_id, machine_id, alarm_key, started_seq, obs_at AS occurred_at, severity FROM tl
  WHERE kind <> 'close' AND {CLASS_SQL.format('severity')} = 'critical'
    AND (kind = 'open' OR {CLASS_SQL.format('severity_before')} <> 'critical'))"""


@query("critical_events", f"{AL}, {CRITICAL_SQL} SELECT machine_id, alarm_key, started_seq, occurred_at, severity FROM ce")
def critical_events(spark, d):
    return ops.critical_events(timeline(spark, d)).drop("company_id", "recv_ms")


@query("alarm_tables", f"""{AL}, {CRITICAL_SQL} SELECT machine_id, count(*) AS periods, count(*) FILTER (WHERE ended_at IS NULL) AS still_open,
  coalesce(max(n), 0) AS events FROM tl LEFT JOIN (SELECT machine_id, count(*) AS n FROM ce GROUP BY 1) c USING (machine_id)
  WHERE kind = 'open' GROUP BY 1""")
def alarm_tables(spark, d):
    from millwright.sources.sinks import write_alarm_tables
    periods, events = write_alarm_tables(timeline(spark, d))
    per = periods.groupBy("machine_id").agg(F.count("*").alias("periods"),
                                            F.count_if(F.col("ended_at").isNull()).alias("still_open"))
    return per.join(events.groupBy("machine_id").agg(F.count("*").alias("events")), "machine_id", "left").withColumn(
        "events", F.coalesce("events", F.lit(0).cast("long")))


@query("severity_class", f"""WITH {READINGS_SQL} SELECT seq, {CLASS_SQL.format('level')} AS severity_class FROM (SELECT seq,
  CASE k % 6 WHEN 0 THEN 'low' WHEN 1 THEN ' Fatal ' WHEN 2 THEN 'CRITICAL' WHEN 3 THEN NULL WHEN 4 THEN 'Message' ELSE 'HIGH' END AS level FROM t)""")
def severity_class(spark, d):
    from millwright.plans.mapping import readings
    k = F.col("k") % 6
    level = (F.when(k == 0, "low").when(k == 1, " Fatal ").when(k == 2, "CRITICAL").when(k == 4, "Message").when(k == 5, "HIGH"))
    return readings(spark, d).select("seq", alarm_text.severity_class(level).alias("severity_class"))


@query("alarm_text", """WITH x AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN text END AS code,
    CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END AS kind, ' ' || source || ' ' AS level FROM documents),
y AS (SELECT *, CASE WHEN kind <> '' THEN kind ELSE 'UNSPECIFIED' END AS whole FROM x),
z AS (SELECT *, CASE WHEN code IS NULL THEN NULL WHEN length(code) <= 50 THEN code
      ELSE substring(code, 1, 33) || '~' || substring(sha256(code), 1, 16) END AS alarm_code,
    CASE WHEN code IS NOT NULL OR length(whole) <= 50 THEN substring(whole, 1, 50)
      ELSE substring(whole, 1, 33) || '~' || substring(sha256(whole), 1, 16) END AS alarm_type FROM y)
SELECT doc_id, alarm_type, alarm_code, substring(upper(trim(level)), 1, 20) AS severity,
  nullif(concat_ws(chr(10), CASE WHEN alarm_type <> whole THEN 'Alarm type: ' || whole END,
    CASE WHEN alarm_code <> code THEN 'Alarm code: ' || code END, nullif(lang, '')), '') AS message FROM z""")
def alarm_text_query(spark, d):
    code = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    kind = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("lang"))
    fields = alarm_text.alarm_fields(kind, code, F.col("lang"), F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", *[fields[n].alias(n) for n in
                                                           ("alarm_type", "alarm_code", "severity", "message")])


ALARMING_SQL = "NOT standalone AND (event_type = 'error' OR k % 9 = 0)"


@query("is_alarming", f"{MSG} SELECT seq, {ALARMING_SQL} AS alarm FROM q")
def is_alarming_query(spark, d):
    return opened(spark, d).select("seq", is_alarming(F.col("fields")).alias("alarm"))


def listed_alarms(spark, d):
    rows = staged(opened(spark, d), alarming=is_alarming(F.col("fields")))
    return staged(rows.where("alarming"), alarms=active_alarms(F.col("fields"), F.lit(True)))


_ROW = "SELECT seq, {n} AS position, {code} AS alarm_code, {kind} AS alarm_type, {msg} AS alarm_message, {sev} AS alarm_severity FROM q WHERE NOT standalone AND "
ACTIVE_SQL = " UNION ALL ".join([
    _ROW.format(n=0, code="'EX' || (1000 + k % 3)", kind="'M' || k % 3 || ' TIMEOUT'",
                msg="'M' || k % 3 || ' TIMEOUT' || CASE WHEN k % 3 > 0 THEN ' (axis ' || k % 3 || ')' ELSE '' END",
                sev="CASE WHEN k % 10 = 0 THEN 'CRITICAL' END") + "event_type = 'error'",
    _ROW.format(n=1, code="'SV0' || (400 + k % 2)", kind="'SV alarm'", msg="NULL", sev="'CRITICAL'") + "event_type = 'error'",
    _ROW.format(n=2, code="CAST(k % 4 AS VARCHAR)", kind="NULL", msg="NULL", sev="NULL") + "event_type = 'error'",
    _ROW.format(n=0, code="NULL", kind="NULL", msg="NULL", sev="NULL") + "event_type <> 'error' AND k % 9 = 0",
])


@query("active_alarms", f"{MSG} {ACTIVE_SQL}")
def active_alarms_query(spark, d):
    return listed_alarms(spark, d).select("seq", F.posexplode("alarms").alias("position", "_a")).select("seq", "position", "_a.*")


@query("alarm_distinct", f"""{MSG}, x AS ({ACTIVE_SQL}) SELECT seq, count(*) AS alarms, count(DISTINCT alarm_code) AS codes FROM x GROUP BY 1""")
def alarm_distinct(spark, d):
    codes = F.array_distinct(F.filter(F.transform("alarms", lambda a: a["alarm_code"]), lambda c: c.isNotNull()))
    return listed_alarms(spark, d).select("seq", F.size("alarms").cast("long").alias("alarms"), F.size(codes).cast("long").alias("codes"))


# --- batteries ------------------------------------------------------------------------------------------
def cells(spark, d):
    """FANUC machines' packets with their battery diagnostics."""
    from millwright.operators.registry import registry_join
    from millwright.operators.admission import topic_key
    from millwright.plans.mapping import registry
    rows = opened(spark, d).withColumn("api_key", topic_key(F.col("topic")))
    joined = registry_join(rows, registry(spark, d).select("api_key", "machine_id", "company_id", "is_active", "controller_type"))
    own = joined.where(battery.supported(F.col("controller_type")))
    return staged(own, acc=battery.encoder_batteries(F.col("fields")), warning=battery.controller_warning(F.col("fields")))


CELL_SQL = """cl AS (SELECT q.*, ((k % 4) * 8 // 8) % 2 = 1 AS x_abp, ((k % 4) * 8 // 16) % 2 = 1 AS x_inp, k % 2 = 1 AS y_low,
    CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS warn
  FROM q JOIN a USING (machine_id) WHERE a.controller_type = 'FANUC' AND NOT standalone)"""


@query("battery_diagnostics", f"""{MSG}, {CELL_SQL} SELECT seq, x_abp OR x_inp AS x_low, x_abp, x_inp, false AS x_exp, y_low,
  CASE WHEN y_low THEN NULL ELSE false END AS y_abp, CAST(NULL AS BOOLEAN) AS z_low, 'ok' AS z_status, warn AS warning, k AS raw_alarm_value FROM cl""")
def battery_diagnostics(spark, d):
    x, y, z = F.col("acc")["X"], F.col("acc")["Y"], F.col("acc")["Z"]
    return cells(spark, d).where(F.col("acc").isNotNull()).select(
        "seq", x["low"].alias("x_low"), x["ABP"].alias("x_abp"), x["INP"].alias("x_inp"), x["EXP"].alias("x_exp"),
        y["low"].alias("y_low"), y["ABP"].alias("y_abp"), z["low"].alias("z_low"), z["status"].alias("z_status"),
        F.col("warning.warning").alias("warning"), F.col("warning.raw_alarm_value").alias("raw_alarm_value"))


_ADVICE = ". Arrange a battery inspection."


@query("battery_alarm_rows", f"""{MSG}, {CELL_SQL}, st AS (
  SELECT seq, 'FANUC_ACC_X_ABP' AS alarm_code, 'Axis X: A/B phase detector battery voltage is low' AS m, x_abp AS active FROM cl
  UNION ALL SELECT seq, 'FANUC_ACC_X_INP', 'Axis X: Built-in serial pulse coder battery voltage is low', x_inp FROM cl
  UNION ALL SELECT seq, 'FANUC_ACC_Y_LOW', 'Axis Y: Absolute encoder battery warning is active', y_low FROM cl
  UNION ALL SELECT seq, 'FANUC_CNC_BATTERY', 'CNC battery warning is active', warn FROM cl)
  SELECT seq, alarm_code, CASE WHEN alarm_code = 'FANUC_CNC_BATTERY' THEN 'CNC BATTERY' ELSE 'ABSOLUTE ENCODER BATTERY' END AS alarm_type,
    m || '{_ADVICE}' AS alarm_message, 'NORMAL' AS alarm_severity FROM st WHERE active""")
def battery_alarm_rows(spark, d):
    states = cells(spark, d).select("seq", F.explode(battery.code_states(F.col("acc"), F.col("warning"))).alias("_s"))
    return states.where("_s.active").select("seq", battery.battery_alarm(F.col("_s.code")).alias("_a")).select("seq", "_a.*")


@query("battery_latch", f"""{FLEET}, b AS (SELECT seq, machine_id, 'FANUC_ACC_X_LOW' AS alarm_code,
    CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false END AS state FROM f WHERE controller_type = 'FANUC')
  SELECT seq, machine_id, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY machine_id, alarm_code ORDER BY seq), false) AS active FROM b""")
def battery_latch(spark, d):
    k = F.col("k") % 6
    rows = fleet(spark, d, "controller_type").where(battery.supported(F.col("controller_type"))).select(
        "seq", "machine_id", F.lit("FANUC_ACC_X_LOW").alias("alarm_code"), F.when(k == 0, True).when(k == 1, False).alias("state"))
    return ops.battery_latch(rows, MAPPED).select("seq", "machine_id", "active")


# --- against stored periods: the periods above, observed again at shifted times ---------------------------
PERIODS_SQL = """pd AS (SELECT company_id, machine_id, CASE WHEN alarm_key LIKE 'SV%' THEN 'FANUC_ACC_' || substring(alarm_key, 1, 2) || '_LOW'
    ELSE alarm_key END AS alarm_key, severity, started_seq, started_at, ended_at, recv_ms AS started_recv_ms, ended_recv_ms,
    started_at AS observed_at, recv_ms AS observed_recv_ms FROM tl WHERE kind = 'open')"""


def stored(spark, d):
    key = F.when(F.startswith("alarm_key", F.lit("SV")), F.lit("FANUC_ACC_SV_LOW")).otherwise(F.col("alarm_key"))
    return ops.alarm_periods(timeline(spark, d)).withColumn("alarm_key", key).withColumn(
        "observed_at", F.col("started_at")).withColumn("observed_recv_ms", F.col("started_recv_ms"))


@query("alarm_open_guard", f"""{AL}, {PERIODS_SQL}, op AS (SELECT seq, company_id, machine_id, alarm_key,
    obs_at + CASE WHEN seq % 2 = 0 THEN 2592000 ELSE 0 END AS obs_at, recv_ms + seq % 3 - 1 AS recv_ms FROM ev WHERE kind = 'open')
  SELECT seq, machine_id, alarm_key FROM op WHERE NOT EXISTS (SELECT 1 FROM pd WHERE pd.company_id = op.company_id AND pd.machine_id = op.machine_id
    AND pd.alarm_key = op.alarm_key AND (ended_at IS NULL OR started_at > op.obs_at OR ended_at > op.obs_at
      OR (started_at = op.obs_at AND started_recv_ms >= op.recv_ms) OR (ended_at = op.obs_at AND ended_recv_ms >= op.recv_ms)))""")
def alarm_open_guard(spark, d):
    events = ops.alarm_events(ops.alarm_diff(alarm_readings(spark, d), MAPPED)).where("kind = 'open'")
    late = F.col("obs_at") + F.when(F.col("seq") % 2 == 0, 2_592_000).otherwise(0)
    opens = events.withColumn("obs_at", late).withColumn("recv_ms", F.col("recv_ms") + F.col("seq") % 3 - 1)
    return ops.open_guard(opens, stored(spark, d)).select("seq", "machine_id", "alarm_key")


REQUESTS_SQL = """rq AS (SELECT company_id, machine_id, max(obs_at) - CASE WHEN machine_id % 4 = 0 THEN 86400 ELSE 0 END AS obs_at,
    max(recv_ms) AS recv_ms, machine_id % 2 = 0 AS is_keep, machine_id % 3 = 0 AS clears, machine_id % 5 > 1 AS preserves FROM f GROUP BY company_id, machine_id)"""


def requests(spark, d):
    """One request per machine at its last reading: named closes, or a keep list after a restart."""
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    late = F.max("obs_at") - F.when(F.col("machine_id") % 4 == 0, 86_400).otherwise(0)
    keep = F.col("machine_id") % 2 == 0
    return fleet(spark, d).groupBy("company_id", "machine_id").agg(late.alias("obs_at"), F.max("recv_ms").alias("recv_ms")).select(
        "*", F.when(~keep, words("EX1000", "FANUC_ACC_SV_LOW")).alias("closes"), F.when(keep, words("EX1001")).alias("keep"),
        F.when(F.col("machine_id") % 3 == 0, words("FANUC_ACC_SV_LOW")).otherwise(words()).alias("battery_clears"),
        (F.col("machine_id") % 5 > 1).alias("preserve_battery"))


@query("alarm_close_match", f"""{AL}, {PERIODS_SQL}, {REQUESTS_SQL} SELECT DISTINCT pd.machine_id, pd.alarm_key, pd.started_at, rq.obs_at AS ended_at
  FROM pd JOIN rq USING (company_id, machine_id) WHERE ended_at IS NULL AND started_at <= rq.obs_at AND observed_at <= rq.obs_at
    AND (observed_at <> rq.obs_at OR observed_recv_ms <= rq.recv_ms)
    AND CASE WHEN is_keep THEN alarm_key <> 'EX1001' AND (alarm_key <> 'FANUC_ACC_SV_LOW' OR clears OR NOT preserves)
      ELSE alarm_key IN ('EX1000', 'FANUC_ACC_SV_LOW') END""")
def alarm_close_match(spark, d):
    return ops.close_match(requests(spark, d), stored(spark, d)).select("machine_id", "alarm_key", "started_at", "ended_at")


STEPS_SQL = f"""el AS (SELECT ev.company_id, ev.machine_id, ev.alarm_key, ev.severity, ev.seq, ev.recv_ms, ev.obs_at + ev.seq % 2 * 60 AS obs_at,
    pd.started_at, pd.severity AS stored, pd.observed_at, pd.observed_recv_ms FROM ev JOIN pd USING (company_id, machine_id, alarm_key)
    WHERE kind <> 'close' AND pd.ended_at IS NULL),
fi AS (SELECT *, obs_at * 100000000000000::HUGEINT + recv_ms AS t FROM el WHERE started_at <= obs_at
    AND (observed_at < obs_at OR observed_at = obs_at AND observed_recv_ms < recv_ms)),
ap AS (SELECT * FROM fi QUALIFY coalesce(t > max(t) OVER (PARTITION BY machine_id, alarm_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
st AS (SELECT *, {CLASS_SQL.format('severity')} <> {CLASS_SQL.format('coalesce(lag(severity) OVER (PARTITION BY machine_id, alarm_key ORDER BY seq), stored)')} AS changed FROM ap)"""


def observed(spark, d):
    seen = ops.alarm_events(ops.alarm_diff(alarm_readings(spark, d), MAPPED)).where("kind <> 'close'")
    return seen.withColumn("obs_at", F.col("obs_at") + F.col("seq") % 2 * 60)


@query("priority_match", f"""{AL}, {PERIODS_SQL}, {STEPS_SQL} SELECT machine_id, alarm_key, started_at, arg_max(severity, seq) AS severity,
  arg_max(obs_at, seq) AS observed_at, arg_max(obs_at, seq) FILTER (WHERE changed) AS priority_changed_at FROM st GROUP BY 1, 2, 3""")
def priority_match(spark, d):
    return ops.priority_match(observed(spark, d), stored(spark, d), MAPPED).select(
        "machine_id", "alarm_key", "started_at", "severity", "observed_at", "priority_changed_at")


@query("priority_events", f"""{AL}, {PERIODS_SQL}, {STEPS_SQL} SELECT machine_id, alarm_key, started_at, obs_at AS occurred_at, severity FROM st
  WHERE changed AND {CLASS_SQL.format('severity')} = 'critical'""")
def priority_events(spark, d):
    return ops.priority_events(observed(spark, d), stored(spark, d), MAPPED).select("machine_id", "alarm_key", "started_at", "occurred_at", "severity")


@query("continuity_reset", f"""{AL}, {PERIODS_SQL}, {REQUESTS_SQL} SELECT machine_id, alarm_key, started_seq,
  CASE WHEN is_keep AND alarm_key = 'EX1001' AND ended_at IS NULL AND started_at <= rq.obs_at THEN greatest(started_at, rq.obs_at)
    ELSE started_at END AS continuity_at FROM pd JOIN rq USING (company_id, machine_id)""")
def continuity_reset(spark, d):
    periods = stored(spark, d).withColumn("continuity_at", F.col("started_at"))
    return ops.continuity_reset(periods, requests(spark, d)).select("machine_id", "alarm_key", "started_seq", "continuity_at")


@query("open_battery_codes", f"""{AL}, {PERIODS_SQL}, tp AS (SELECT machine_id, alarm_key FROM pd WHERE ended_at IS NULL AND alarm_key LIKE 'FANUC_ACC_%'
    QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY started_at DESC, alarm_key) <= 65)
  SELECT machine_id, string_agg(alarm_key, ',' ORDER BY alarm_key) AS codes FROM tp GROUP BY 1""")
def open_battery_codes(spark, d):
    return ops.open_battery_codes(stored(spark, d)).select("machine_id", F.array_join("codes", ",").alias("codes"))
