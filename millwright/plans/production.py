"""Queries: registry and shifts, counters, energy, state time, gaps, hourly production."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.clock import hour_start, second_of_day
from millwright.functions.status import machine_status, status_alarm
from millwright.operators import production as ops
from millwright.operators import registry as reg
from millwright.operators import shifts as shift_ops
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED, READINGS_SQL, REGISTRY_SQL, SHIFTS_SQL, ACTIVE_SQL
from millwright.plans.mapping import fleet, readings, registry, shifts

CAL = shift_ops.shift_calendar


def steps_of(spark, d, keep=()):
    """The columns every production query starts from, narrowed before the shuffle, and those to ``keep``."""
    base = fleet(spark, d).select("seq", *keep, "machine_id", "company_id", "obs_at", "machine_status", "mode",
                                  F.col("parts_count").cast("long").alias("parts_count"), "energy")
    return ops.production_steps(base, MAPPED)


@query("machine_registry", f"WITH {REGISTRY_SQL}, {ACTIVE_SQL} SELECT machine_id, api_key, company_id, plant_id, "
                           "machine_serial_no, controller_type FROM a")
def machine_registry(spark, d):
    return reg.active_machines(registry(spark, d)).select(
        "machine_id", "api_key", "company_id", "plant_id", "machine_serial_no", "controller_type")


@query("shift_calendar", f"WITH {SHIFTS_SQL} SELECT CAST(shift_id AS BIGINT) AS shift_id, company_id, start_s, end_s FROM s")
def shift_calendar(spark, d):
    return CAL(shifts(spark, d))


@query("registry_join", f"{FLEET} SELECT seq, machine_id, company_id, plant_id FROM f")
def registry_join(spark, d):
    sent = readings(spark, d).select("seq", F.concat(F.lit("k"), F.col("machine_id")).alias("api_key"))
    return reg.registry_join(sent, registry(spark, d)).select("seq", "machine_id", "company_id", "plant_id")


@query("unknown_machines", f"{FLEET} SELECT machine_id, count(*) AS messages FROM t "
                           "WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.machine_id = t.machine_id) GROUP BY 1")
def unknown_machines(spark, d):
    sent = readings(spark, d).select("machine_id", F.concat(F.lit("k"), F.col("machine_id")).alias("api_key"))
    return reg.unknown_machines(sent, registry(spark, d)).groupBy("machine_id").agg(F.count("*").alias("messages"))


@query("normalize_status", f"WITH {READINGS_SQL} SELECT seq, CASE WHEN upper(status_word) IN ('RUN','RUNNING','CUTTING') "
                           "THEN 'RUNNING' ELSE 'IDLE' END AS machine_status, upper(status_word) = 'ALARM' AS alarm FROM t")
def normalize_status(spark, d):
    w = F.col("status_word")
    return readings(spark, d).select("seq", machine_status(w).alias("machine_status"), status_alarm(w).alias("alarm"))


@query("ist_time", f"""WITH {READINGS_SQL} SELECT seq, (obs_at + 19800) // 3600 * 3600 - 19800 AS hour_start,
  (obs_at + 19800) % 86400 AS second_of_day,
  (obs_at + 19800) % 86400 + (seq % 4) * 0.25E0 AS second_of_day_exact FROM (SELECT *, recv_s AS obs_at FROM t)""")
def ist_time(spark, d):
    obs_at = F.col("recv_s")
    exact = obs_at.cast("double") + (F.col("seq") % 4) * F.lit(0.25)
    return readings(spark, d).select("seq", hour_start(obs_at).alias("hour_start"),
                                     second_of_day(obs_at).alias("second_of_day"),
                                     second_of_day(exact).alias("second_of_day_exact"))


SHIFT_AT_SQL = """(SELECT min(s.shift_id) FROM s WHERE s.company_id = {c} AND
  CASE WHEN start_s <= end_s THEN ({t} + 19800) % 86400 BETWEEN start_s AND end_s
       ELSE ({t} + 19800) % 86400 >= start_s OR ({t} + 19800) % 86400 <= end_s END)"""


@query("shift_at", f"{FLEET} SELECT seq, CAST({SHIFT_AT_SQL.format(c='f.company_id', t='f.edge')} AS BIGINT) AS shift_id "
                   "FROM (SELECT *, CASE WHEN seq % 4 = 0 THEN (obs_at + 19800) // 28800 * 28800 + 1800 ELSE obs_at END AS edge FROM f) f")
def shift_at(spark, d):
    # a quarter of the instants is moved onto a shift boundary, where the lower id wins
    edge = F.when(F.col("seq") % 4 == 0, F.expr("(obs_at + 19800) div 28800 * 28800 + 1800")).otherwise(F.col("obs_at"))
    df = fleet(spark, d).select("seq", "company_id", edge.alias("edge"))
    return shift_ops.with_shift_at(df, CAL(shifts(spark, d)), "edge").select("seq", "shift_id")


# --- shared oracle steps: counters, meter, previous state ------------------------------------------------
STEPS_SQL = """
g1 AS (SELECT f.*, lag(obs_at) OVER w AS prev_at, lag(machine_status) OVER w AS prev_status, lag(mode) OVER w AS prev_mode,
    sum(CASE WHEN parts_count <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id ORDER BY seq) AS run_no,
    last_value(CASE WHEN energy > 0 THEN seq END IGNORE NULLS)
      OVER (PARTITION BY machine_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS meter_seq
  FROM f WINDOW w AS (PARTITION BY machine_id ORDER BY seq)),
g2 AS (SELECT g1.*, max(parts_count) OVER (PARTITION BY machine_id, run_no ORDER BY seq) AS baseline FROM g1),
g3 AS (SELECT g2.*, lag(baseline) OVER (PARTITION BY machine_id ORDER BY seq) AS baseline_before,
    coalesce(greatest(obs_at - prev_at, 0), 0) AS gap_s, e_energy AS meter_before, e_at AS meter_before_at
  FROM g2 LEFT JOIN (SELECT seq AS eseq, energy AS e_energy, obs_at AS e_at FROM f) e ON e.eseq = g2.meter_seq),
g4 AS (SELECT g3.*,
    coalesce(parts_count < baseline_before AND parts_count > 2, false) AS regressed,
    CAST(CASE WHEN baseline_before IS NULL OR parts_count IS NULL THEN 0
      WHEN parts_count < baseline_before THEN CASE WHEN parts_count <= 2 THEN parts_count ELSE 0 END
      WHEN parts_count - baseline_before >= 5 AND baseline_before <= 2 AND gap_s < 28800 THEN 0
      WHEN parts_count - baseline_before > CASE WHEN gap_s >= 28800 THEN 5000 ELSE 20 END THEN 0
      ELSE parts_count - baseline_before END AS BIGINT) AS produced,
    CASE WHEN NOT coalesce(energy > 0, false) OR meter_before IS NULL THEN NULL
      WHEN energy - meter_before < 0 THEN 0.0E0
      WHEN energy - meter_before > 2000 * greatest(obs_at - meter_before_at, 300) / 3600.0 THEN 0.0E0
      ELSE energy - meter_before END AS energy_delta,
    coalesce(meter_before_at, obs_at) AS meter_from FROM g3),
g5 AS (SELECT *, gap_s > 28800 AS long_gap, coalesce(energy_delta > 0, false) AS used,
    coalesce(energy_delta > 0, false) AND obs_at - meter_from > 28800 AS long_meter_gap FROM g4)
"""
STEPS = f"{FLEET}, {STEPS_SQL}"


@query("counter_baseline", f"{STEPS} SELECT seq, machine_id, CAST(baseline_before AS BIGINT) AS baseline_before, "
                           "CAST(baseline AS BIGINT) AS baseline FROM g5")
def counter_baseline(spark, d):
    return counters(spark, d).select("seq", "machine_id", "baseline_before", "baseline")


def counters(spark, d):
    return ops.counter_steps(fleet(spark, d).select(
        "seq", "machine_id", "obs_at", F.col("parts_count").cast("long").alias("parts_count")), MAPPED)


@query("parts_delta", f"{STEPS} SELECT seq, machine_id, gap_s, produced, regressed FROM g5")
def parts_delta(spark, d):
    return counters(spark, d).select("seq", "machine_id", "gap_s", "produced", "regressed")


@query("counter_uncertain", f"""{STEPS}, u AS (SELECT *, CASE WHEN regressed THEN true
    WHEN parts_count IS NOT NULL AND (baseline_before IS NULL OR parts_count <= 2 OR parts_count > baseline_before)
    THEN false END AS event FROM g5)
  SELECT seq, machine_id, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY seq), false)
    AS uncertain FROM u""")
def counter_uncertain(spark, d):
    from millwright.session import materialise
    return ops.counter_uncertain(materialise(counters(spark, d)), MAPPED).select("seq", "machine_id", "uncertain")


@query("energy_step", f"{STEPS} SELECT seq, machine_id, energy_delta, meter_before, meter_before_at FROM g5")
def energy_step(spark, d):
    return ops.energy_steps(fleet(spark, d).select("seq", "machine_id", "obs_at", "energy"), MAPPED).select(
        "seq", "machine_id", "energy_delta", "meter_before", "meter_before_at")


GAPS_SQL = """gaps AS (SELECT seq, company_id, machine_id,
    CASE WHEN long_gap THEN least(prev_at, CASE WHEN used THEN meter_from ELSE prev_at END) ELSE meter_from END AS gap_from,
    obs_at AS gap_to, obs_at - CASE WHEN long_gap THEN least(prev_at, CASE WHEN used THEN meter_from ELSE prev_at END)
      ELSE meter_from END AS gap_seconds, CAST(CASE WHEN long_gap THEN 28800 ELSE 0 END AS BIGINT) AS known_state_seconds,
    CASE WHEN long_gap THEN produced ELSE CAST(0 AS BIGINT) END AS unallocated_parts, energy_delta AS unallocated_energy,
    'observations_missing' AS reason FROM g5 WHERE long_gap OR long_meter_gap)"""


@query("observation_gaps", f"{STEPS}, {GAPS_SQL} SELECT * FROM gaps")
def observation_gaps(spark, d):
    return ops.gap_records(steps_of(spark, d), MAPPED)


@query("unallocated_totals", f"""{STEPS}, {GAPS_SQL} SELECT machine_id, CAST(sum(unallocated_parts) AS BIGINT) AS unallocated_parts,
  round(sum(coalesce(unallocated_energy, 0)), 6) AS unallocated_energy, max_by(gap_from, seq) AS last_gap_from,
  max_by(gap_to, seq) AS last_gap_to FROM gaps GROUP BY 1""")
def unallocated_totals(spark, d):
    return ops.unallocated_totals(ops.gap_records(steps_of(spark, d), MAPPED)).withColumn(
        "unallocated_energy", F.round("unallocated_energy", 6))


@query("state_intervals", f"""{STEPS}, i AS (SELECT *, CASE WHEN long_gap THEN prev_at + 28800 ELSE obs_at END AS end_at FROM g5)
  SELECT seq, company_id, machine_id, prev_at AS start_at, end_at,
    upper(prev_status) IN ('RUN','RUNNING','CUTTING') AS running, upper(prev_mode) IN ('MANUAL','SETUP') AS manual,
    CASE WHEN long_gap THEN CAST(0 AS BIGINT) ELSE produced END AS produced FROM i WHERE prev_at < end_at""")
def state_intervals(spark, d):
    return ops.state_intervals(steps_of(spark, d), MAPPED)


BOOKINGS_SQL = """
bk AS (
  SELECT company_id, machine_id, seq, prev_at AS x, CASE WHEN long_gap THEN prev_at + 28800 ELSE obs_at END AS y, true AS timed,
    upper(prev_status) IN ('RUN','RUNNING','CUTTING') AS running, upper(prev_mode) IN ('MANUAL','SETUP') AS manual,
    CASE WHEN long_gap THEN 0 ELSE produced END AS produced,
    CASE WHEN used AND NOT long_gap AND NOT long_meter_gap AND meter_from = prev_at THEN energy_delta END AS energy
  FROM g5 WHERE prev_at < CASE WHEN long_gap THEN prev_at + 28800 ELSE obs_at END
  UNION ALL SELECT company_id, machine_id, seq, obs_at, obs_at, false, false, false, produced, NULL
  FROM g5 WHERE prev_at = obs_at AND produced > 0
  UNION ALL SELECT company_id, machine_id, seq, meter_from, obs_at, false, false, false, 0, energy_delta
  FROM g5 WHERE used AND NOT long_gap AND NOT long_meter_gap
    AND (prev_at IS NULL OR meter_from <> prev_at OR obs_at = meter_from)),
cuts AS (
  SELECT DISTINCT seq, timed, company_id, x, y, c FROM (
    SELECT seq, timed, company_id, x, y, unnest([x, y]) AS c FROM bk
    UNION ALL SELECT seq, timed, company_id, x, y,
      unnest(range((x + 19800) // 3600 * 3600 - 19800 + 3600, y, 3600)) FROM bk
    UNION ALL SELECT bk.seq, bk.timed, bk.company_id, x, y, day + b FROM bk,
      LATERAL (SELECT unnest(range((x + 19800) // 86400 * 86400 - 19800, y, 86400)) AS day),
      (SELECT unnest([21600, 46800, 50400, 79200]) AS b))
  WHERE c >= x AND c <= y),
sl AS (SELECT *, lead(c) OVER (PARTITION BY seq, timed, x, y ORDER BY c) AS nx FROM cuts),
pieces AS (
  SELECT bk.*, p.c, p.nx - p.c AS seconds, p.nx = bk.y AS is_last FROM bk JOIN sl p
    ON p.seq = bk.seq AND p.timed = bk.timed AND p.x = bk.x AND p.y = bk.y WHERE p.nx IS NOT NULL
  UNION ALL SELECT bk.*, x, 0, true FROM bk WHERE x = y),
sh AS (SELECT p.*, (SELECT min(s.shift_id) FROM s WHERE s.company_id = p.company_id AND
    CASE WHEN start_s <= end_s THEN (c + seconds / 2.0 + 19800) % 86400 BETWEEN start_s AND end_s
       ELSE (c + seconds / 2.0 + 19800) % 86400 >= start_s OR (c + seconds / 2.0 + 19800) % 86400 <= end_s END) AS shift_id
  FROM pieces p),
slices AS (SELECT seq, company_id, machine_id, CAST(shift_id AS BIGINT) AS shift_id,
    (c + 19800) // 3600 * 3600 - 19800 AS hour_start,
    CASE WHEN timed AND running THEN seconds ELSE 0 END AS run, CASE WHEN timed AND NOT running THEN seconds ELSE 0 END AS idle,
    CASE WHEN timed AND manual THEN seconds ELSE 0 END AS manual, CASE WHEN is_last THEN produced ELSE 0 END AS produced,
    coalesce(CASE WHEN y > x THEN energy * seconds / (y - x) ELSE energy END, 0) AS energy FROM sh WHERE shift_id IS NOT NULL)
"""


@query("interval_split", f"""{STEPS}, {BOOKINGS_SQL} SELECT seq, machine_id, shift_id, hour_start, c AS slice_from, seconds, is_last
  FROM (SELECT seq, machine_id, CAST(shift_id AS BIGINT) AS shift_id, c, seconds, is_last,
    (c + 19800) // 3600 * 3600 - 19800 AS hour_start FROM sh WHERE timed AND shift_id IS NOT NULL)""")
def interval_split(spark, d):
    spans = ops.state_intervals(steps_of(spark, d), MAPPED).select("seq", "company_id", "machine_id", "start_at", "end_at")
    return shift_ops.split_interval(spans, shift_ops.calendar_segments(CAL(shifts(spark, d))), "start_at", "end_at").select(
        "seq", "machine_id", "shift_id", "hour_start", "slice_from", "seconds", "is_last")


HOURLY_SQL = """SELECT machine_id, shift_id, hour_start, min(company_id) AS company_id, CAST(sum(run) AS BIGINT) AS run_seconds,
  CAST(sum(idle) AS BIGINT) AS idle_seconds, CAST(sum(manual) AS BIGINT) AS manual_seconds,
  CAST(sum(produced) AS BIGINT) AS produced_qty, round(sum(energy), 6) AS energy_kwh FROM slices{where} GROUP BY 1, 2, 3"""


@query("production_hourly", f"{STEPS}, {BOOKINGS_SQL} {HOURLY_SQL.format(where='')}")
def production_hourly(spark, d):
    hourly = ops.production_hourly(ops.production_slices(steps_of(spark, d), CAL(shifts(spark, d)), MAPPED))
    return hourly.withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("energy_allocation", f"""{STEPS}, {BOOKINGS_SQL} SELECT machine_id, shift_id, hour_start, round(sum(energy), 6) AS energy_kwh
  FROM slices WHERE energy > 0 GROUP BY 1, 2, 3""")
def energy_allocation(spark, d):
    s = ops.production_slices(steps_of(spark, d), CAL(shifts(spark, d)), MAPPED).where(F.col("energy") > 0)
    return s.groupBy("machine_id", "shift_id", "hour_start").agg(F.round(F.sum("energy"), 6).alias("energy_kwh"))


@query("processing_counters", f"""{STEPS} SELECT count(*) FILTER (WHERE regressed) AS parts_counter_regression,
  CAST(sum(CASE WHEN long_gap OR long_meter_gap THEN produced ELSE 0 END) AS BIGINT) AS unallocated_parts FROM g5""")
def processing_counters(spark, d):
    return ops.processing_counters(steps_of(spark, d))
