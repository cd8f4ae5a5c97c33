"""Queries: meters, lag, live and latest state, tables and their sinks, quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import lag, meters, production, quality, tables
from millwright.operators.registry import active_machines
from millwright.operators.shifts import shift_calendar
from millwright.plans.alarms import AL, PERIODS_SQL, stored
from millwright.operators.alarms import open_battery_codes
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED, READINGS_SQL, REGISTRY_SQL, fleet, readings, registry, shifts, table
from millwright.plans.production import BOOKINGS_SQL, GAPS_SQL, SHIFT_AT_SQL, STEPS, steps_of

T = f"WITH {READINGS_SQL}"
FIELDS = ("v_ll_avg", "kw_total", "kwh_total", "aux_interrupts")


def newest_second(spark, d) -> int:
    """The clock of a batch job: the last receipt."""
    return readings(spark, d).agg(F.max("recv_s")).first()[0]


NOW_SQL = "(SELECT max(recv_s) FROM t)"


# --- meters ---------------------------------------------------------------------------------------------
def observations(spark, d):
    k = F.col("k")
    return fleet(spark, d).select(
        "machine_id", F.expr("obs_at div 86400").alias("read_at"), "seq", "standalone", "lag_ms",
        F.when(F.col("seq") % 17 == 0, F.col("company_id") + 1).otherwise(F.col("company_id")).alias("company_id"),
        F.when(k % 3 != 0, 400.0 + k % 30).alias("v_ll_avg"), F.when(k % 4 != 0, k / 4.0).alias("kw_total"),
        F.when(k % 5 != 0, F.col("meter_kwh")).alias("kwh_total"), F.when(k % 2 == 0, k.cast("int")).alias("aux_interrupts"))


OBS_SQL = """ob AS (SELECT machine_id, obs_at // 86400 AS read_at, seq, standalone, lag_ms, CASE WHEN seq % 17 = 0 THEN company_id + 1 ELSE company_id END AS company_id,
  CASE WHEN k % 3 <> 0 THEN 400.0E0 + k % 30 END AS v_ll_avg, CASE WHEN k % 4 <> 0 THEN k / 4.0E0 END AS kw_total,
  CASE WHEN k % 5 <> 0 THEN meter_kwh END AS kwh_total, CASE WHEN k % 2 = 0 THEN CAST(k AS INTEGER) END AS aux_interrupts FROM f)"""


def merged_sql(source: str, out: str) -> str:
    pick = ", ".join(f"coalesce(max_by({n}, seq) FILTER (WHERE standalone AND {n} IS NOT NULL), max_by({n}, seq) FILTER (WHERE {n} IS NOT NULL)) AS {n}"
                     for n in FIELDS)
    names = " || ".join(f"CASE WHEN bool_or(standalone AND {n} IS NOT NULL) THEN '{n},' ELSE '' END" for n in sorted(FIELDS))
    return f"""{out} AS (SELECT machine_id, read_at, any_value(owner) AS company_id, bool_or(standalone) AS standalone, {pick},
      rtrim({names}, ',') AS standalone_fields FROM (SELECT *, first_value(company_id) OVER (PARTITION BY machine_id, read_at ORDER BY seq) AS owner FROM {source})
    WHERE company_id = owner GROUP BY machine_id, read_at)"""


def flat(df):
    return df.withColumn("standalone_fields", F.array_join("standalone_fields", ","))


@query("meter_same_second", f"{FLEET}, {OBS_SQL}, {merged_sql('ob', 'mg')} SELECT * EXCLUDE (standalone_fields) FROM mg")
def meter_same_second(spark, d):
    return meters.merge_observations(meters.with_mask(observations(spark, d), FIELDS), FIELDS).drop("standalone_fields")


@query("standalone_fields", f"{FLEET}, {OBS_SQL}, {merged_sql('ob', 'mg')} SELECT machine_id, read_at, standalone_fields FROM mg")
def standalone_fields(spark, d):
    return flat(meters.merge_observations(meters.with_mask(observations(spark, d), FIELDS), FIELDS)).select(
        "machine_id", "read_at", "standalone_fields")


@query("meter_merge", f"{FLEET}, {OBS_SQL}, {merged_sql('ob', 'mg')} SELECT * FROM mg")
def meter_merge(spark, d):
    """First half of the arrivals stored, the rest merged in: the same rows as one merge of all."""
    obs = observations(spark, d)
    cut = F.col("seq") <= F.lit(obs.agg((F.max("seq") / 2).cast("long")).first()[0])
    stored_rows = meters.merge_observations(meters.with_mask(obs.where(cut), FIELDS), FIELDS)
    return flat(meters.meter_merge(stored_rows, obs.where(~cut), FIELDS))


@query("meter_latest_fields", f"""{FLEET}, {OBS_SQL} {' UNION ALL '.join(f"SELECT machine_id, '{n}' AS field, CAST(max_by({n}, seq) AS DOUBLE) AS value, max_by(read_at, seq) AS observed_at FROM ob WHERE standalone AND {n} IS NOT NULL GROUP BY 1" for n in FIELDS)}""")
def meter_latest_fields(spark, d):
    return meters.latest_fields(observations(spark, d).where("standalone"), FIELDS)


@query("meter_observations", f"""{FLEET}, {OBS_SQL} SELECT seq, machine_id, read_at, kwh_total,
  CASE WHEN lag_ms > 300000 THEN 'late' WHEN standalone THEN 'standalone' ELSE 'snapshot' END AS lane FROM ob WHERE kwh_total IS NOT NULL""")
def meter_observations(spark, d):
    own = observations(spark, d).where(F.col("kwh_total").isNotNull()).select("seq", "machine_id", "read_at", "kwh_total", "standalone", "lag_ms")
    late = F.col("lag_ms") > 300_000
    lane = lambda df, n: df.select("seq", "machine_id", "read_at", "kwh_total", F.lit(n).alias("lane"))
    return meters.meter_observations(lane(own.where(~late & ~F.col("standalone")), "snapshot"),
                                     lane(own.where(~late & F.col("standalone")), "standalone"), lane(own.where(late), "late"))


# --- lag ------------------------------------------------------------------------------------------------
LAG_SQL = f"lg AS (SELECT machine_id, max_by(lag_ms, seq) AS lag_ms, max_by(recv_ms, seq) AS at_ms FROM t GROUP BY 1), ls AS (SELECT machine_id, lag_ms FROM lg WHERE {NOW_SQL} * 1000 - at_ms <= 86400000)"


@query("lag_snapshot", f"{T}, {LAG_SQL} SELECT * FROM ls")
def lag_snapshot(spark, d):
    return lag.lag_snapshot(readings(spark, d), newest_second(spark, d) * 1000, MAPPED)


@query("worst_lag", f"{T}, {LAG_SQL} SELECT * FROM ls ORDER BY lag_ms DESC, machine_id LIMIT 1")
def worst_lag(spark, d):
    return lag.worst_lag(lag_snapshot(spark, d))


@query("late_windows", f"""{T} SELECT machine_id, recv_ms // 60000 * 60 AS window_start, count(*) AS late_readings, max(lag_ms) AS worst_ms,
  CAST(max(lag_ms) > 60000 AS INTEGER) + CAST(max(lag_ms) > 120000 AS INTEGER) + CAST(max(lag_ms) > 240000 AS INTEGER) AS step FROM t WHERE lag_ms > 10000 GROUP BY 1, 2""")
def late_windows(spark, d):
    return lag.late_windows(readings(spark, d), MAPPED)


@query("lag_episodes", f"""{T}, e AS (SELECT machine_id, seq, recv_ms, lag_ms > 10000 AS late, coalesce(lag(lag_ms > 10000) OVER w, false) AS was,
    first_value(CASE WHEN lag_ms <= 10000 THEN recv_ms END IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recovered_ms
    FROM t WINDOW w AS (PARTITION BY machine_id ORDER BY seq))
  SELECT machine_id, seq AS started_seq, recv_ms AS started_ms, recovered_ms FROM e WHERE late AND NOT was""")
def lag_episodes(spark, d):
    return lag.lag_episodes(readings(spark, d), MAPPED)


# --- states and tables ------------------------------------------------------------------------------------
@query("latest_per_machine", f"""{FLEET} SELECT machine_id, max_by(parts_count, seq) AS parts_count, max_by(mode, seq) AS mode, max(recv_s) AS recv_s FROM
  (SELECT seq, machine_id, mode, recv_s, coalesce(parts_count, -1) AS parts_count FROM f) WHERE recv_s > {NOW_SQL} - 604800 GROUP BY 1""")
def latest_per_machine(spark, d):
    rows = fleet(spark, d).withColumn("parts_count", F.coalesce("parts_count", F.lit(-1)))
    return tables.latest_per_machine(rows, "recv_s", newest_second(spark, d), ["parts_count", "mode", "recv_s"], MAPPED)


@query("latest_state", f"{FLEET} SELECT machine_id, max(seq) AS seq, max_by(machine_status, seq) AS machine_status, max_by(energy, seq) AS energy FROM f GROUP BY 1")
def latest_state(spark, d):
    return tables.latest_state(fleet(spark, d), ["machine_status", "energy"])


@query("live_state", f"""{FLEET} SELECT machine_id, max(seq) AS seq, max(recv_s) AS ingested_at, max_by(device_time, seq) AS device_time, max_by(machine_status, seq) AS machine_status
  FROM f GROUP BY 1 HAVING max(recv_s) > {NOW_SQL} - 86400""")
def live_state(spark, d):
    return tables.live_state(fleet(spark, d), ["device_time", "machine_status"], newest_second(spark, d), MAPPED)


@query("payload_sample", f"""{FLEET} SELECT machine_id, recv_s // 21600 * 21600 AS window_start, max(seq) AS seq, max_by(status_word || ':' || k, seq) AS payload
  FROM f WHERE recv_s >= {NOW_SQL} - 604800 GROUP BY 1, 2""")
def payload_sample(spark, d):
    rows = fleet(spark, d).withColumn("payload", F.concat_ws(":", "status_word", "k"))
    return tables.payload_sample(rows, newest_second(spark, d), MAPPED)


@query("bootstrap_baseline", f"""{AL}, {PERIODS_SQL}, tel AS (SELECT machine_id, max_by(struct_pack(p := parts_count, s := machine_status, m := mode, d := device_time), seq) AS r
    FROM f WHERE recv_s > {NOW_SQL} - 604800 GROUP BY 1),
  en AS (SELECT machine_id, arg_max(struct_pack(e := energy, t := obs_at, s := CASE WHEN standalone THEN obs_at END), seq) AS r FROM f
    WHERE recv_s > {NOW_SQL} - 604800 AND energy > 0 GROUP BY 1),
  bc AS (SELECT machine_id, string_agg(alarm_key, ',' ORDER BY alarm_key) AS codes FROM pd WHERE ended_at IS NULL AND alarm_key LIKE 'FANUC_ACC_%' GROUP BY 1)
  SELECT a.machine_id, CAST(tel.r.p AS BIGINT) AS parts_count, tel.r.s AS machine_status, tel.r.m AS mode, tel.r.d AS device_time, en.r.e AS energy_meter, en.r.t AS energy_meter_at,
    en.r.s AS energy_standalone_at, bc.codes FROM a LEFT JOIN tel USING (machine_id) LEFT JOIN en USING (machine_id) LEFT JOIN bc USING (machine_id)
  WHERE tel.r IS NOT NULL OR en.r IS NOT NULL OR bc.codes IS NOT NULL""")
def bootstrap_baseline(spark, d):
    rows = fleet(spark, d)
    base = tables.bootstrap_baseline(
        active_machines(registry(spark, d)), rows.withColumn("parts_count", F.col("parts_count").cast("long")),
        rows.withColumn("observed_at", F.col("obs_at")), open_battery_codes(stored(spark, d)), newest_second(spark, d), MAPPED)
    return base.withColumn("codes", F.array_join("codes", ","))


BLANK_SQL = "CASE WHEN seq % 3 = 0 THEN NULL ELSE company_id END"


@query("tenant_backfill", f"""WITH {READINGS_SQL}, {REGISTRY_SQL} SELECT seq, machine_id, m.company_id FROM t JOIN m USING (machine_id)""")
def tenant_backfill(spark, d):
    owners = registry(spark, d)
    rows = readings(spark, d).join(owners.select("machine_id", "company_id"), "machine_id").select(
        "seq", "machine_id", F.when(F.col("seq") % 3 != 0, F.col("company_id")).alias("company_id"))
    return tables.tenant_backfill(rows, owners)


@query("tenant_null_check", f"""{FLEET} SELECT 'telemetry_raw' AS "table", count(*) FILTER (WHERE seq % 3 = 0) AS missing FROM f
  UNION ALL SELECT 'production_hourly', count(*) FILTER (WHERE seq % 5 = 0) FROM f UNION ALL SELECT 'oee_hourly', count(*) FILTER (WHERE k = 0) FROM f
  UNION ALL SELECT 'oee_shift_summary', count(*) FILTER (WHERE k = 200) FROM f""")
def tenant_null_check(spark, d):
    f = fleet(spark, d)
    blank = lambda cond: f.select(F.when(~cond, F.col("company_id")).alias("company_id"))
    return tables.tenant_null_check({
        "telemetry_raw": blank(F.col("seq") % 3 == 0), "production_hourly": blank(F.col("seq") % 5 == 0),
        "oee_hourly": blank(F.col("k") == 0), "oee_shift_summary": blank(F.col("k") == 200)})


@query("late_rows", f"""{FLEET} SELECT seq, machine_id, company_id, device_time, recv_s, 'stale' AS reason FROM f WHERE lag_ms > 300000 AND recv_s >= {NOW_SQL} - 864000""")
def late_rows(spark, d):
    late = fleet(spark, d).where(F.col("lag_ms") > MAPPED.max_stale_ms).select(
        "seq", "machine_id", "company_id", "device_time", "recv_s", F.lit("stale").alias("reason"))
    return tables.retained(late, "recv_s", newest_second(spark, d), MAPPED.late_retention_s)


COLLECTED_SQL = "cr AS (SELECT seq + 1 AS seq, machine_id % 3 AS collector_id FROM t), ck AS (SELECT c AS collector_id, c * 500 AS last_seq FROM (VALUES (0), (1), (5)) v(c))"


def collected(spark, d):
    records = readings(spark, d).select((F.col("seq") + 1).alias("seq"), (F.col("machine_id") % 3).alias("collector_id"))
    marks = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("c")).where("c IN (0, 1)").unionAll(
        table(spark, d, "region").select(F.col("r_regionkey").cast("long") + 1).where("r_regionkey = 4"))
    return records, marks.select(F.col("c").alias("collector_id"), (F.col("c") * 500).alias("last_seq"))


@query("skip_replayed", f"{T}, {COLLECTED_SQL} SELECT cr.* FROM cr LEFT JOIN ck USING (collector_id) WHERE seq > coalesce(last_seq, 0)")
def skip_replayed(spark, d):
    return tables.skip_replayed(*collected(spark, d)).select("seq", "collector_id")


@query("replay_safe_commit", f"""{T}, {COLLECTED_SQL} SELECT coalesce(ck.collector_id, o.collector_id) AS collector_id, greatest(last_seq, s) AS last_seq
  FROM ck FULL JOIN (SELECT collector_id, max(seq) AS s FROM cr GROUP BY 1) o USING (collector_id)""")
def replay_safe_commit(spark, d):
    records, marks = collected(spark, d)
    once = tables.advance_checkpoints(records, marks)
    # the same batch again: nothing is left to apply and no checkpoint moves
    return tables.advance_checkpoints(tables.skip_replayed(records, once), once)


@query("gap_rows", f"""{STEPS}, {GAPS_SQL} SELECT gaps.* EXCLUDE (seq), gaps.seq AS journal_seq, gaps.machine_id % 3 AS collector_id,
  epoch_ms(recv_ms) AS received_at FROM gaps JOIN g5 USING (seq) WHERE gaps.seq % 4 <> 0""")
def gap_rows(spark, d):
    """Every fourth number is stored already; every fifth too, but by another collector."""
    gaps = production.gap_records(steps_of(spark, d, ("recv_ms",)), MAPPED, ("recv_ms",)).withColumn("collector_id", F.col("machine_id") % 3)
    number, own = F.col("seq"), F.col("machine_id") % 3
    marks = readings(spark, d).select(F.explode(F.array_compact(F.array(F.when(number % 4 == 0, own), F.when(number % 5 == 0, own + 1)))).alias("collector_id"), number.alias("journal_seq"))
    return tables.gap_rows(marks, gaps)


@query("hourly_upsert", f"""{STEPS}, {BOOKINGS_SQL} SELECT machine_id, shift_id, hour_start, min(company_id) AS company_id, CAST(sum(run) AS BIGINT) AS run_seconds,
  CAST(sum(idle) AS BIGINT) AS idle_seconds, CAST(sum(manual) AS BIGINT) AS manual_seconds, CAST(sum(produced) AS BIGINT) AS produced_qty, round(sum(energy), 6) AS energy_kwh
  FROM slices GROUP BY 1, 2, 3""")
def hourly_upsert(spark, d):
    """Two batches added to the table one after the other equal one aggregation of everything."""
    from millwright.session import dealt, scratch_table
    slices = scratch_table(production.production_slices(
        steps_of(spark, d), shift_calendar(shifts(spark, d)), MAPPED), "slices")
    half = F.pmod(F.hash("machine_id", "hour_start", "run", "energy"), F.lit(2)) == 0
    key = ["machine_id", "shift_id", "hour_start"]  # one task sums a key of both batches and of the table
    spread = dealt(slices, key)
    first, second = (production.production_hourly(spread.where(part)) for part in (half, ~half))
    return production.merge_hourly(first, second).withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("same_second_quantity", f"""{FLEET.replace('t.recv_s AS obs_at', 't.recv_s // 86400 * 86400 AS obs_at')}, {STEPS[len(FLEET) + 2:]} SELECT seq, machine_id, obs_at, (obs_at + 19800) // 3600 * 3600 - 19800 AS hour_start, produced, energy, shift_id FROM (
  SELECT seq, machine_id, obs_at, CAST({SHIFT_AT_SQL.format(c='g5.company_id', t='g5.obs_at')} AS BIGINT) AS shift_id, CASE WHEN prev_at IS NOT NULL AND gap_s = 0 THEN produced ELSE 0 END AS produced,
    CASE WHEN used AND meter_from = obs_at AND NOT long_gap THEN energy_delta ELSE 0.0E0 END AS energy FROM g5) WHERE (produced > 0 OR energy > 0) AND shift_id IS NOT NULL""")
def same_second_quantity(spark, d):
    """Device times cut to the day, so that consecutive readings share a second."""
    rows = fleet(spark, d).withColumn("obs_at", F.expr("recv_s div 86400 * 86400")).select(
        "seq", "machine_id", "company_id", "obs_at", "machine_status", "mode", F.col("parts_count").cast("long").alias("parts_count"), "energy")
    return production.same_second(production.production_steps(rows, MAPPED), shift_calendar(shifts(spark, d)), MAPPED).drop("company_id")


IDENTITY_SQL = "idn AS (SELECT seq, machine_id, recv_s, CASE WHEN k % 3 > 0 THEN 's' || k // 25 END AS cnc_series, CASE WHEN k % 7 = 0 THEN 1 + k % 2 END AS focas FROM t)"


def identities(spark, d):
    return readings(spark, d).select("seq", "machine_id", "recv_s", F.expr("CASE WHEN k % 3 > 0 THEN concat('s', k div 25) END").alias("cnc_series"),
                                     F.expr("CASE WHEN k % 7 = 0 THEN 1 + k % 2 END").alias("focas"))


@query("identity_changes", f"""{T}, {IDENTITY_SQL}, x AS (SELECT *, row_number() OVER w AS rn, lag(cnc_series) OVER w AS ps, lag(focas) OVER w AS pf FROM idn
    WINDOW w AS (PARTITION BY machine_id ORDER BY seq))
  SELECT seq, machine_id, cnc_series, focas FROM x WHERE rn = 1 OR cnc_series IS DISTINCT FROM ps OR focas IS DISTINCT FROM pf""")
def identity_changes(spark, d):
    rows = identities(spark, d).withColumn("identity", F.col("cnc_series"))
    return tables.identity_changes(rows, MAPPED).select("seq", "machine_id", "cnc_series", "focas")


@query("identity_update", f"""WITH {READINGS_SQL}, {REGISTRY_SQL}, {IDENTITY_SQL} SELECT m.machine_id, m.api_key, coalesce(n.s, m.cnc_series) AS cnc_series, n.seen AS controller_seen_at
  FROM m LEFT JOIN (SELECT machine_id, max_by(cnc_series, seq) FILTER (WHERE cnc_series IS NOT NULL) AS s, max(recv_s) AS seen FROM idn GROUP BY 1) n USING (machine_id)""")
def identity_update(spark, d):
    return tables.identity_update(registry(spark, d).select("machine_id", "api_key", "cnc_series"), identities(spark, d), ["cnc_series"])


@query("batch_stats", f"""{T} SELECT seq // 1000 AS batch, count(*) AS "rows", count(*) FILTER (WHERE lag_ms > 300000) AS late_rows, count(*) FILTER (WHERE k = 98) AS bad_records,
  max(recv_ms) - min(recv_ms) AS span_ms FROM t GROUP BY 1""")
def batch_stats(spark, d):
    rows = readings(spark, d).select(F.expr("seq div 1000").alias("batch"), "recv_ms", (F.col("lag_ms") > 300_000).alias("late"), (F.col("k") == 98).alias("bad"))
    return tables.batch_stats(rows, "batch")


# --- rows a table cannot hold, and the quarantine file ----------------------------------------------------
@query("quarantine", """SELECT doc_id, CASE WHEN length(text) > 900 THEN '22001' ELSE '23502' END AS code, CASE WHEN length(text) > 900 THEN 'text' ELSE 'source' END AS "column",
  'database_rejected' AS reason FROM documents WHERE length(text) > 900 OR doc_id % 7 = 0""")
def quarantine(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    _, bad = quality.split_storable(docs, {"text": 900}, ("source",))
    return bad.select("doc_id", "code", "column", "reason")


@query("reject_text_lengths", """SELECT doc_id // 100 AS batch, f AS field, max(n) AS longest FROM (SELECT doc_id, 'text' AS f, length(text) AS n FROM documents
  UNION ALL SELECT doc_id, 'source', length(source) FROM documents) GROUP BY 1, 2""")
def reject_text_lengths(spark, d):
    docs = table(spark, d, "documents").withColumn("batch", F.expr("doc_id div 100"))
    return quality.longest_texts(docs, "batch", ["text", "source"])


def quarantine_lines(spark, d):
    """Dead letters as NDJSON lines in file order: some torn, some too long, some blank."""
    return readings(spark, d).selectExpr("seq AS pos", """CASE WHEN k = 11 THEN '{"at":' WHEN k = 12 THEN '  ' WHEN k = 13 THEN repeat('x', 2000) WHEN k = 14 THEN '{"a":1} tail' ELSE
      concat('{"at":"2024-01-', CASE WHEN k % 4 = 0 THEN '77' ELSE '01' END, 'T00:00:00.000Z","reason":"', CASE WHEN k % 2 = 0 THEN 'database_rejected' ELSE 'other' END, '","code":"', CASE WHEN k % 3 = 0 THEN '22001' ELSE 'bad' END,
        '","stage":"', CASE WHEN k % 5 = 0 THEN 'machine alarms; --' ELSE 'machine_alarms' END, '","record":{"s":', seq, ',"r":{"machine_id":', machine_id, ',"company_id":"', machine_id % 5,
        '","device_time":', device_time, ',"mode":"', mode, '"},"a":{"opens":[{"alarm_code":"', repeat('ü', CAST(k AS INT)), '"}]}}}') END AS value""")


LETTER = MAPPED.with_(max_line_bytes=1_000)
LETTERS_SQL = "lt AS (SELECT seq AS pos, CASE WHEN k % 4 > 0 THEN '2024-01-01T00:00:00.000Z' END AS quarantined_at, 0 AS alarm_index, nullif(seq, 0) AS sequence, nullif(machine_id, 0) AS machine_id, nullif(machine_id % 5, 0) AS company_id, device_time, CASE WHEN k % 2 = 0 THEN 'database_rejected' ELSE 'unclassified' END AS reason, CASE WHEN k % 3 = 0 THEN '22001' END AS sqlstate, CASE WHEN k % 5 > 0 THEN 'machine_alarms' END AS stage, length(mode) AS mode_chars, k AS code_chars FROM t WHERE k NOT IN (11, 12, 13, 14))"


def letters(spark, d):
    summary = quality.quarantine_summary(quality.parse_quarantine(quarantine_lines(spark, d), LETTER))
    chars = lambda c: F.get(F.filter("text_fields", lambda t: t["column"] == c), F.lit(0))["characters"]
    index = F.get(F.filter("text_fields", lambda t: t["column"] == "alarm_code"), F.lit(0))["alarm_index"]
    return summary.select("pos", "quarantined_at", index.alias("alarm_index"), "sequence", "machine_id", "company_id", "device_time", "reason", "sqlstate", "stage",
                          chars("mode").alias("mode_chars"), chars("alarm_code").alias("code_chars"))


@query("quarantine_summary", f"{T}, {LETTERS_SQL} SELECT * FROM lt")
def quarantine_summary(spark, d):
    return letters(spark, d)


@query("quarantine_counts", f"{T} SELECT CASE WHEN k = 13 THEN 'oversized' WHEN k IN (11, 14) THEN 'malformed' ELSE 'record' END AS state, count(*) AS lines FROM t WHERE k <> 12 GROUP BY 1")
def quarantine_counts(spark, d):
    return quality.quarantine_counts(quality.parse_quarantine(quarantine_lines(spark, d), LETTER))


@query("quarantine_list", f"{T}, {LETTERS_SQL} SELECT * FROM lt WHERE machine_id = 7 ORDER BY pos LIMIT 10")
def quarantine_list(spark, d):
    return quality.quarantine_list(letters(spark, d), machine=7, limit=10)
