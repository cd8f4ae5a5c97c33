"""Queries: number readers, electrical and condition signals, telemetry rows, range guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import meter, numbers, signals
from millwright.functions.payload import staged
from millwright.operators import admission, quality
from millwright.operators.registry import registry_join
from millwright.operators.telemetry import telemetry_rows
from millwright.plans.admission import MSG, OUTCOME_SQL, opened
from millwright.plans.catalog import query
from millwright.plans.mapping import MAPPED, READINGS_SQL, messages, readings, registry

T = f"WITH {READINGS_SQL}"


def snapshots(spark, d):
    return opened(spark, d).where(F.map_contains_key("fields", F.lit("parts_count")))


@query("lenient_number", f"""{T} SELECT seq, CASE k % 5 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 1 THEN k + 0.5 WHEN 2 THEN NULL WHEN 3 THEN NULL
    ELSE CAST(-k AS DOUBLE) END AS n, CAST(CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k WHEN 4 THEN -k END AS BIGINT) AS i FROM t""")
def lenient_number(spark, d):
    k = F.col("k").cast("string")
    kind = F.col("k") % 5
    text = (F.when(kind == 0, F.concat(k, F.lit(" rpm"))).when(kind == 1, F.concat(F.lit(" "), k, F.lit(",5,7")))
            .when(kind == 2, F.lit("true")).when(kind == 3, F.lit("1e999")).otherwise(F.concat(F.lit("-"), k, F.lit(".x"))))
    df = readings(spark, d).select("seq", text.alias("text"))
    return df.select("seq", numbers.lenient_number(F.col("text")).alias("n"), numbers.lenient_int(F.col("text")).alias("i"))


@query("energy_quantity", f"""{T} SELECT seq, CASE k % 7 WHEN 0 THEN k / 1.0E0 WHEN 1 THEN k / 1000.0E0 WHEN 2 THEN k * 1000.0E0
    WHEN 3 THEN k + 0.25E0 ELSE NULL END AS kwh FROM t""")
def energy_quantity(spark, d):
    k, kind = F.col("k").cast("string"), F.col("k") % 7
    text = (F.when(kind == 0, F.concat(k, F.lit(" kWh"))).when(kind == 1, F.concat(k, F.lit("Wh"))).when(kind == 2, F.concat(k, F.lit(" MWh ")))
            .when(kind == 3, F.concat(k, F.lit(",25"))).when(kind == 4, F.concat(k, F.lit(" mWh"))).when(kind == 5, F.concat(F.lit("-1"), k))
            .otherwise(F.concat(k, F.lit(" kWh?"))))
    return readings(spark, d).select("seq", text.alias("text")).select("seq", numbers.energy_quantity(F.col("text")).alias("kwh"))


@query("power_quantity", f"""{T} SELECT seq, CASE k % 5 WHEN 0 THEN -k / 1000.0E0 + 0 WHEN 1 THEN k * 1000.0E0 WHEN 2 THEN CAST(k AS DOUBLE) END AS kw FROM t""")
def power_quantity(spark, d):
    k, kind = F.col("k").cast("string"), F.col("k") % 5
    text = (F.when(kind == 0, F.concat(F.lit("-"), k, F.lit(" W"))).when(kind == 1, F.concat(k, F.lit("MW"))).when(kind == 2, k)
            .when(kind == 3, F.concat(k, F.lit(" mW"))).otherwise(F.concat(k, F.lit(" kWh"))))
    unit = F.when(kind == 2, "kW")
    df = readings(spark, d).select("seq", text.alias("text"), unit.alias("unit"))
    return df.select("seq", numbers.power_quantity(F.col("text"), F.col("unit"), F.col("unit").isNotNull()).alias("kw"))


@query("parts_count", f"{MSG} SELECT seq, CAST(parts_count AS BIGINT) AS parts_count FROM q WHERE NOT standalone")
def parts_count(spark, d):
    return snapshots(spark, d).select("seq", numbers.strict_count(F.col("fields")["parts_count"]).alias("parts_count"))


@query("temperature_guard", f"""{MSG} SELECT seq, CAST(nullif(k % 4, 0) AS DOUBLE) AS spindle_motor_temp,
  CAST(nullif(k % 50, 0) AS DOUBLE) AS servo_temp_y, CAST(0 AS DOUBLE) AS cnc_battery_voltage FROM q WHERE NOT standalone""")
def temperature_guard(spark, d):
    rows = staged(snapshots(spark, d), **signals.axis_maps(F.col("fields")))
    c = signals.condition_columns(F.col("fields"))
    return rows.select("seq", c["spindle_motor_temp"].alias("spindle_motor_temp"),
                       F.col("_servo_temp")["Y"].alias("servo_temp_y"), c["cnc_battery_voltage"].alias("cnc_battery_voltage"))


KWH_SQL = "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 6 = 2 THEN meter_kwh * 1000.0E0 / 1000.0E0 ELSE meter_kwh END"
ELECTRIC_SQL = f"""SELECT seq, {KWH_SQL} AS energy, CASE WHEN standalone THEN NULL WHEN k % 23 = 0 THEN 415.5E0 ELSE CAST(400 + k % 30 AS DOUBLE) END AS voltage,
  CASE WHEN standalone THEN NULL ELSE k % 50 + 0.25E0 END AS current, CASE WHEN standalone THEN k / 4.0E0 WHEN k % 5 = 0 THEN k * 100 / 1000.0E0
    ELSE -k / 10.0E0 + 0 END AS power"""


@query("electrical_signals", f"{MSG} {ELECTRIC_SQL} FROM q WHERE depth_ok AND time_ok")
def electrical_signals(spark, d):
    p = admission.parse(messages(spark, d)).where("envelope_ok")
    e = meter.electrical_signals(F.col("fields"), F.col("power"), F.col("energy_data"))
    return p.select("seq", *[c.alias(n) for n, c in e.items()])


def meter_rows(spark, d):
    """Parsed packets with their 52 meter columns; packets that supply none are left out."""
    p = admission.parse(messages(spark, d)).where("envelope_ok")
    wide = staged(p, **meter.meter_columns(F.col("fields"), F.col("power"), F.col("energy_data")))
    cols = meter.meter_fields()
    rows = staged(wide, **cols)
    return rows.where(F.coalesce(*[F.col(n).cast("double") for n in meter.NAMES]).isNotNull())


@query("meter_wide", f"""{MSG} SELECT seq, {KWH_SQL} AS kwh_total, CAST(CASE WHEN NOT standalone THEN 240.5 END AS FLOAT) AS v_ln_avg,
  CAST(CASE WHEN NOT standalone THEN k END AS FLOAT) AS kw1, CAST(CASE WHEN NOT standalone THEN 0.9E0 END AS FLOAT) AS pf1,
  CASE WHEN NOT standalone THEN k * 10.0E0 END AS run_hours, CAST(CASE WHEN NOT standalone AND k % 31 > 0 THEN k END AS INTEGER) AS aux_interrupts,
  (CASE WHEN k % 19 = 0 THEN 0 ELSE 1 END + CASE WHEN standalone THEN 1 ELSE 7 + CASE WHEN k % 31 > 0 THEN 1 ELSE 0 END END) AS supplied
  FROM q WHERE depth_ok AND time_ok""")
def meter_wide(spark, d):
    supplied = sum((F.col(n).isNotNull().cast("int") for n in meter.NAMES), F.lit(0))
    return meter_rows(spark, d).select("seq", "kwh_total", "v_ln_avg", "kw1", "pf1", "run_hours", "aux_interrupts",
                                       supplied.alias("supplied"))


@query("axis_split", f"""{MSG} SELECT seq, CAST(k AS DOUBLE) AS servo_load_x, k + 0.5E0 AS servo_load_y, CAST(NULL AS DOUBLE) AS servo_load_z,
  CAST(NULL AS DOUBLE) AS servo_temp_x, CAST(nullif(k % 50, 0) AS DOUBLE) AS servo_temp_y, CAST(nullif(k % 3, 0) AS DOUBLE) AS encoder_temp_z FROM q WHERE NOT standalone""")
def axis_split(spark, d):
    rows = staged(snapshots(spark, d), **signals.axis_maps(F.col("fields")))
    c = signals.axis_columns()
    return rows.select("seq", *[c[n].alias(n) for n in ("servo_load_x", "servo_load_y", "servo_load_z", "servo_temp_x",
                                                        "servo_temp_y", "encoder_temp_z")])


@query("extra_axes", f"""{MSG} SELECT seq, x.axis, CASE WHEN x.axis = 'A' THEN 3.0E0 END AS servo_load, CASE WHEN x.axis = 'B' THEN 45.0E0 END AS servo_temp
  FROM q, (VALUES ('A'), ('B')) x(axis) WHERE NOT standalone""")
def extra_axes(spark, d):
    rows = staged(snapshots(spark, d), **signals.axis_maps(F.col("fields")))
    return rows.select("seq", F.explode(signals.axis_columns()["extra_axes"]).alias("axis", "_v")).select(
        "seq", "axis", "_v.servo_load", "_v.servo_temp")


@query("fan_status", f"""{MSG} SELECT seq, CASE WHEN k % 3 = 0 THEN true END AS fan1_on, CASE WHEN k % 3 = 0 THEN false END AS fan1_fault,
  CASE WHEN k % 3 = 0 THEN k * 10.0E0 END AS fan1_rpm, CASE WHEN k % 3 > 0 THEN 'OK' END AS radiator, CASE WHEN k % 3 > 0 THEN CAST(k AS VARCHAR) END AS f2,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS fans FROM q WHERE NOT standalone""")
def fan_status(spark, d):
    rows = staged(snapshots(spark, d), fan=signals.condition_columns(F.col("fields"))["fan_status"])
    fan = F.col("fan")
    return rows.select("seq", fan["FAN1"]["on"].alias("fan1_on"), fan["FAN1"]["fault"].alias("fan1_fault"),
                       fan["FAN1"]["rpm"].alias("fan1_rpm"), fan["radiator"]["word"].alias("radiator"),
                       fan["F2"]["word"].alias("f2"), F.size(fan).alias("fans"))


@query("battery_flags", f"{MSG} SELECT seq, k % 2 = 0 AS x, false AS y, 2 AS axes FROM q WHERE NOT standalone")
def battery_flags(spark, d):
    b = signals.battery_flags(F.col("fields")["battery"])
    return staged(snapshots(spark, d), b=b).select("seq", F.col("b")["X"].alias("x"), F.col("b")["Y"].alias("y"), F.size("b").alias("axes"))


@query("bounded_entries", f"{T} SELECT seq, least(k, 16) AS kept FROM t")
def bounded_entries(spark, d):
    """Fan maps of k fans each, none for zero: the first sixteen stay."""
    numbers = F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("long"), F.col("k"))).otherwise(F.array().cast("array<long>"))
    fans = F.concat(F.lit("{"), F.array_join(F.transform(numbers, lambda i: F.concat(
        F.lit('"F'), i.cast("string"), F.lit('":'), i.cast("string"))), ","), F.lit("}"))
    kept = signals.fan_status(F.col("fans"))
    rows = readings(spark, d).select("seq", fans.alias("fans"))
    return rows.select("seq", F.when(kept.isNotNull(), F.size(kept)).otherwise(0).cast("long").alias("kept"))


@query("alias_projection", f"""{MSG} SELECT seq, k + 0.5E0 AS cutting_speed, k AS program_number, k * 3600 AS total_run_time, mode FROM q WHERE NOT standalone""")
def alias_projection(spark, d):
    c = signals.process_columns(F.col("fields"))
    return snapshots(spark, d).select("seq", *[c[n].alias(n) for n in ("cutting_speed", "program_number", "total_run_time", "mode")])


@query("controller_identity", f"""{MSG} SELECT seq, '10.0.0.' || machine_id % 250 AS controller_ip, CASE WHEN NOT standalone THEN CAST(k // 25 AS VARCHAR) END AS cnc_series,
  CASE WHEN NOT standalone THEN '' END AS cnc_type, CAST(CASE WHEN NOT standalone THEN 3 + k % 2 END AS INTEGER) AS controlled_axes FROM q""")
def controller_identity(spark, d):
    c = signals.identity_columns(F.col("fields"))
    told = F.coalesce(*[x.cast("string") for x in c.values()]).isNotNull()
    return opened(spark, d).where(told).select("seq", *[c[n].alias(n) for n in ("controller_ip", "cnc_series", "cnc_type", "controlled_axes")])


@query("call_results", f"""{MSG} SELECT seq, '{{"stat":' || k % 2 || '}}' AS focas_result FROM q WHERE NOT standalone AND k % 4 = 0""")
def call_results(spark, d):
    rows = opened(spark, d).select("seq", signals.call_results(F.col("fields")).alias("focas_result"))
    return rows.where(F.col("focas_result").isNotNull())


@query("condition_signals", f"""{MSG} SELECT seq, 1000.0E0 + k AS spindle_speed, CAST(nullif(k % 4, 0) AS DOUBLE) AS spindle_motor_temp, CAST(k AS DOUBLE) AS servo_load_x,
  CAST(nullif(k % 3, 0) AS DOUBLE) AS encoder_temp_z, k AS sequence_number, 0.0E0 AS cnc_battery_voltage FROM q WHERE NOT standalone""")
def condition_signals(spark, d):
    f = F.col("fields")
    rows = staged(snapshots(spark, d), **signals.axis_maps(f), **signals.condition_columns(f))
    axes = signals.axis_columns()
    return rows.select("seq", "spindle_speed", "spindle_motor_temp", axes["servo_load_x"].alias("servo_load_x"),
                       axes["encoder_temp_z"].alias("encoder_temp_z"), "sequence_number", "cnc_battery_voltage")


TELEMETRY_SQL = f"""{MSG}, {OUTCOME_SQL} SELECT seq, a.company_id, a.plant_id, machine_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'RUNNING' ELSE 'IDLE' END AS machine_status,
  event_type = 'error' OR k % 9 = 0 AS alarm, CASE WHEN k % 20 = 7 THEN NULL ELSE k END AS status, CAST(parts_count AS BIGINT) AS parts_count, obs_at AS device_time, mode,
  {KWH_SQL} AS energy, CASE WHEN k % 23 = 0 THEN 415.5E0 ELSE CAST(400 + k % 30 AS DOUBLE) END AS voltage, 1000 + k AS spindle_speed, k AS program_number,
  CASE WHEN controller_type = 'FANUC' THEN ((k % 4) * 8 // 8) > 0 ELSE k % 2 = 0 END AS battery_x, 47 AS columns
  FROM @rows"""


def telemetry_columns(rows):
    return rows.select("seq", "company_id", "plant_id", "machine_id", "machine_status", "alarm", "status", "parts_count", "device_time",
                       "mode", "energy", "voltage", "spindle_speed", "program_number", F.col("apc_battery_status")["X"].alias("battery_x"),
                       F.lit(len(rows.columns) - 1).alias("columns"))


@query("telemetry_rows", TELEMETRY_SQL.replace("@rows", "q JOIN a USING (machine_id) WHERE NOT standalone AND depth_ok AND time_ok"))
def telemetry(spark, d):
    p = admission.parse(messages(spark, d)).where("envelope_ok AND NOT is_energy")
    machines = registry(spark, d).select("api_key", "machine_id", "company_id", "plant_id", "controller_type", "is_active")
    return telemetry_columns(telemetry_rows(registry_join(p, machines)))


@query("range_guard", f"""{T} SELECT machine_id, c AS "column", recv_ms // 600000 * 600 AS window_start, count(*) AS violations, min_by(v, seq) AS first_value FROM (
    SELECT seq, machine_id, recv_ms, 'status' AS c, k * 1000.0E0 AS v FROM t WHERE k * 1000 > 32767
    UNION ALL SELECT seq, machine_id, recv_ms, 'parts_count', k * 100000000.0E0 FROM t WHERE k * 100000000 > 2147483647) GROUP BY 1, 2, 3""")
def range_guard(spark, d):
    rows = readings(spark, d).select("seq", "machine_id", "recv_ms", (F.col("k") * 1000.0).alias("status"),
                                     (F.col("k") * 100_000_000.0).alias("parts_count"))
    return quality.range_violations(rows, ["status", "parts_count"], MAPPED).drop("first_sent")
