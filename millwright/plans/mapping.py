"""The given tables read as telemetry: one reading per event, one machine per customer.

Every column is a row-local expression over the scan, so filters and column
pruning reach the Parquet reader. Each has a Spark and a DuckDB spelling; the
oracles use the second. Time lies in January 2024 and the median distance of a
machine's readings is hours, hence ``MAPPED`` parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.params import Params
from millwright.session import compiled_methods, scratch_table

# gap limits stretched to the spacing of the given events; everything else as in production
MAPPED = Params(freshness_s=28_800, gap_recovery_s=28_800, forget_ms=86_400_000, live_ttl_s=86_400,
                late_retention_s=10 * 86_400, sample_window_s=21_600)

EPOCH_2024 = 1_704_067_200

# column -> expression; {div} is whole-number division. Later entries may use earlier ones.
COLUMNS: list[list[tuple[str, str]]] = [
    [("seq", "event_id"), ("machine_id", "user_id"), ("event_type", "event_type"), ("value", "value"),
     ("recv_s", "{recv_s}"), ("k", "{k}")],
    [("recv_ms", "recv_s * 1000 + seq % 1000"), ("hours", "(recv_s - 1704067200) {div} 900"),
     ("lag_s", "CASE WHEN seq % 11 = 0 THEN 400 + seq % 97 WHEN seq % 5 = 0 THEN 20 + seq % 60 ELSE seq % 4 END"),
     ("status_word", "CASE event_type WHEN 'purchase' THEN 'RUN' WHEN 'click' THEN 'Cutting' WHEN 'view' THEN 'STOP' "
                     "WHEN 'signup' THEN 'setup' ELSE 'alarm' END"),
     ("mode", "CASE k % 4 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'setup' ELSE 'AUTO' END"),
     ("cents", "(recv_s - 1704067200) * (30 + machine_id % 40) {div} 36")],
    [("device_time", "recv_s - lag_s"), ("dt_ooo", "recv_s - (seq % 7) * 7200"),
     ("lag_ms", "lag_s * 1000 + seq % 1000"),
     ("cum", "(hours + machine_id % 5) % 90"),
     ("meter_kwh", "CASE WHEN k % 10 = 0 THEN 0.0E0 WHEN k = 97 THEN cents * 100.0E0 WHEN k = 98 THEN 1.0E0 "
                   "ELSE cents / 100.0E0 END")],
    [("parts_count", "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN NULL WHEN k % 13 = 0 THEN 5 "
                     "WHEN k % 17 = 3 THEN k % 3 WHEN k % 29 = 0 THEN cum + 150 ELSE cum END"),
     ("standalone", "event_type IN ('view', 'signup')"),
     ("sent_s", "CASE WHEN seq % 109 = 0 THEN recv_s + 120 WHEN seq % 7 = 3 THEN recv_s - 40000 "
                "WHEN seq % 11 = 0 THEN recv_s - 90000 ELSE recv_s - seq % 4 END")],
    [("no_time", "standalone AND seq % 9 = 4 AND seq % 107 > 0 AND seq % 109 > 0 AND seq % 137 > 0 AND seq % 139 > 0")],
]

_SPARK = {"div": "div", "recv_s": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
          "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
_DUCK = {"div": "//", "recv_s": "epoch_us(ts) // 1000000",
         "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """``parts``: tasks that the events are dealt to first, while their rows are narrow."""
    df = table(spark, sf_dir, "events")
    if parts:
        df = df.repartition(parts)
    keep: list[str] = []
    for step in COLUMNS:
        df = df.selectExpr(*keep, *[f"{e.format(**_SPARK)} AS {n}" for n, e in step])
        keep += [n for n, _ in step]
    return df


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS machine_id", "concat('k', c_custkey) AS api_key", "CAST(c_nationkey AS BIGINT) AS company_id",
        "CAST(c_nationkey % 5 AS BIGINT) AS plant_id", "c_name AS machine_serial_no",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FANUC' ELSE 'OTHER' END AS controller_type",
        "c_acctbal >= 0 AS is_active", "lower(c_mktsegment) AS cnc_series")


# fixed values: three shifts of every company, and a retired one that covers the whole day
SHIFTS = [(1, "06:00", "14:00:00", True), (2, "14:00:00", "22:00:00.75", True),
          (3, "22:00:00", "06:00", True), (4, "00:00", "23:59:59", False)]


# companies without the night shift, and companies whose second shift begins an hour early
NO_NIGHT, EARLY = "n_nationkey % 5 = 2", "n_nationkey % 7 = 3"


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(a).alias("start_time"),
                              F.lit(b).alias("end_time"), F.lit(on).alias("is_active")) for n, a, b, on in SHIFTS])
    start = F.when(F.expr(EARLY) & (F.col("s.n") == 2), "13:00").otherwise(F.col("s.start_time"))
    on = F.col("s.is_active") & ~(F.expr(NO_NIGHT) & (F.col("s.n") == 3))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rows).alias("s")).select(
        (F.col("n_nationkey") * 10 + F.col("s.n")).cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("company_id"),
        start.alias("start_time"), "s.end_time", on.alias("is_active"))


def fleet(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Readings of registered machines with company and plant; ``obs_at`` is the device second."""
    from millwright.operators.registry import active_machines
    machines = active_machines(registry(spark, sf_dir)).select("machine_id", "company_id", *extra)
    return readings(spark, sf_dir).withColumn("obs_at", F.col("recv_s")).withColumn(
        "machine_status", F.col("status_word")).withColumn("energy", F.col("meter_kwh")).join(machines, "machine_id")


# the stale limit that goes with the given spacing: readings are sent up to 40,000 s late without being stale. Packets
# are numbered by receipt, eight numbers a millisecond, so a chunk of arrivals is 24 days and each machine has two
SENT = MAPPED.with_(max_stale_ms=80_000_000, chunk_seqs=1 << 34)

# JSON text of one packet, from the columns above; k picks spellings, units and defects
_TIME = """CASE WHEN no_time THEN '' ELSE concat('"time":', CASE WHEN seq % 107 = 0 THEN concat(sent_s, '000')
  WHEN seq % 137 = 0 THEN '"soon"' WHEN seq % 139 = 0 THEN concat(sent_s, '.5') WHEN seq % 10 = 1 THEN concat('"', sent_s, '"')
  ELSE CAST(sent_s AS STRING) END, ',') END"""
_LINK = """CASE seq % 37 WHEN 0 THEN '"connection":false,' WHEN 1 THEN '"connection":"0",' WHEN 2 THEN '"connection":0,'
  WHEN 3 THEN '"connection":"false",' WHEN 4 THEN '"connection":null,' WHEN 5 THEN '' ELSE '"Connection":true,' END"""
_KWH = """CASE WHEN k % 19 = 0 THEN '' WHEN k % 6 = 0 THEN concat('"Energy":', meter_kwh, ',')
  WHEN k % 6 = 1 THEN concat('"energy":"', meter_kwh, ' kWh",')
  WHEN k % 6 = 2 THEN concat('"Energy_Data":{"Total_Wh":', meter_kwh * 1000.0E0, '},')
  WHEN k % 6 = 3 THEN concat('"EnergyFormatted":"', replace(CAST(meter_kwh AS STRING), '.', ','), 'kwh",')
  ELSE concat('"Energy":"n/a","EnergyData":{"value":"', meter_kwh, '","unit":"kWh"},') END"""
_POWER = """concat('"PowerData":{"Average_Voltage_LN":240.5,', CASE WHEN k % 23 = 0 THEN '' ELSE
  concat('"Average_Voltage_LL":', 400 + k % 30, ',') END, '"Average_Current":"', k % 50, ',25","kW1":', k, ',"PF1":0.9,',
  '"Run_Hour":', k * 10, ',"Auxiliary_Interrupts":', CASE WHEN k % 31 = 0 THEN '3000000000' ELSE concat(k, '.7') END,
  ',"Total_kW":', CASE WHEN k % 5 = 0 THEN '"12 W"' ELSE CAST(-k / 10.0E0 AS STRING) END, '},',
  CASE WHEN k % 23 = 0 THEN '"volts":" 415,5 ",' ELSE '' END,
  CASE WHEN k % 5 = 0 THEN concat('"power":', k * 100, ',"power_unit":"W",') ELSE '' END)"""
_AXES = """concat('"servo_axis_load_percent":{"X":', k, ',"y ":"', k, ',5","A":3},"servo_motor_temperature":{"X":0,"Y":', k % 50,
  ',"b":"45 C"},', CASE WHEN k % 2 = 0 THEN '"Encoder_temperature"' ELSE '"encoder_temperatures"' END, ':{"Z":', k % 3,
  '},"spindle_speed":"', 1000 + k, ' rpm","spindle_temperature":', k % 4, ',"cnc_battery":0,"current_sequence_number":"', k, '.9",')"""
_FANS = """concat('"cnc_fans":', CASE WHEN k % 3 = 0 THEN concat('{"FAN1":{"on":true,"fault":0,"rpm":', k * 10, '},"FAN2":null,"FAN3":[1]}')
  WHEN k % 3 = 1 THEN '{"FAN1":{"state":1}}' ELSE 'null' END, ',"fans":{"radiator":"OK","F2":', k, ',"F3":""},',
  '"battery":{"x":', CASE WHEN k % 2 = 0 THEN 'true' ELSE '"0"' END, ',"Y ":0,"Z":"maybe"},')"""
_ALARM = """CASE WHEN event_type = 'error' THEN concat('"pmc_alarm":{"exist":1,"alarms":[{"number":', 1000 + k % 3,
  ',"type":15,"axis":', k % 3, ',"message":" M', k % 3, ' TIMEOUT "},{"number":', 400 + k % 2, ',"type":"sv"},"', k % 4, '",{"x":1},',
  '{"code":"EX', 1000 + k % 3, '"}]},', CASE WHEN k % 10 = 0 THEN '"stat_emergency":1,' ELSE '"stat_alarm":1,' END)
  WHEN k % 9 = 0 THEN '"pmc_alarm":{"exist":0,"count":"1","alarms":[]},' WHEN k % 9 = 1 THEN '"stat_alarm":true,' ELSE '' END"""
_CELLS = """concat('"acc_battery":{" x":{"raw":', (k % 4) * 8, '},"Y":{"low":', CASE WHEN k % 2 = 0 THEN 'false' ELSE '"1"' END,
  '},"Z":{"raw":"x","status":" ok "},"9":{"raw":0}},"cnc_battery_warning":{"warning":', CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN 'false'
  ELSE '"?"' END, ',"raw_alarm_value":', k, '},')"""
_IDENTITY = """concat('"series":"', k div 25, '","version":', k div 50, ',"cnc_type":"", "controlled_axes":"', 3 + k % 2, ' axes",',
  '"focas_result":', CASE WHEN k % 4 = 0 THEN concat('{"stat":', k % 2, '}') WHEN k % 4 = 1 THEN '[]' ELSE 'null' END, ',')"""
_PROCESS = """concat(CASE WHEN seq % 3 = 0 THEN '" Machine_Status "' ELSE '"machine_status"' END, ':"', status_word, '","Mode":"', mode,
  '","parts_count":', CASE WHEN parts_count IS NULL THEN 'null' WHEN k % 7 = 0 THEN concat('" ', parts_count, ' "')
  ELSE CAST(parts_count AS STRING) END, ',', CASE WHEN k % 3 = 0 THEN '"surface_speed"' ELSE '"cutting_speed"' END, ':"', k, ',5 m",',
  CASE k % 3 WHEN 0 THEN '"program_number"' WHEN 1 THEN '"program_no"' ELSE '"o_number"' END, ':"', k, '.8",',
  CASE WHEN k % 2 = 0 THEN '"total_run_time"' ELSE '"powered_on_time"' END, ':', k * 3600, ',"status":', CASE WHEN k % 20 = 7
  THEN '42279658848' ELSE concat(k, '.9') END, ',"feed_rate":"', k * 10, '",')"""

_BODY = f"""concat('{{', {_TIME}, {_LINK}, {_KWH}, CASE WHEN standalone THEN concat('"kw":', k / 4.0E0, ',') ELSE
  concat({_PROCESS}, {_POWER}, {_AXES}, {_FANS}, {_ALARM}, {_CELLS}, {_IDENTITY}) END,
  CASE WHEN seq % 113 = 0 THEN concat('"deep":', repeat('[', 13), '1', repeat(']', 13), ',') ELSE '' END,
  CASE WHEN seq % 131 = 0 THEN concat('"pad":"', repeat('x', 66000), '",') ELSE '' END,
  '"Machine_IP":"10.0.0.', machine_id % 250, '"}}')"""
_PAYLOAD = "CASE WHEN seq % 101 = 0 THEN substring(body, 1, 40) WHEN seq % 103 = 0 THEN concat('[', body, ']') ELSE body END"


def stamp(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What changes when a table does: its files' number, sizes and times."""
    out = [spark.sparkContext.applicationId, sf_dir]
    for name in names:
        files = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out.append(tuple(files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time")).first()))
    return tuple(out)


_LANDED: dict[tuple, DataFrame] = {}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw packets (seq, topic, payload, recv_ms): every event as JSON, every 13th delivered twice, every 26th five times.

    The copies come 5, 205 and 405 seconds and 25 hours after the first.

    Landed once per application as a Parquet table, as raw packets would be, in
    enough files to parse them on every core. Events are dealt to the tasks that
    write them, so no text of a packet is shuffled.
    """
    written = readings(spark, sf_dir, spark.sparkContext.defaultParallelism * 2).selectExpr("seq", "machine_id", "recv_ms", f"{_BODY} AS body")
    sent = written.selectExpr(
        "seq", "machine_id", f"{_PAYLOAD} AS payload", "recv_ms",
        "CASE WHEN seq % 127 = 0 THEN 'machines//telemetry' ELSE concat('machines/k', machine_id, '/telemetry') END AS topic",
        "explode(CASE WHEN seq % 26 = 0 THEN array(0, 1, 2, 3, 4) WHEN seq % 13 = 0 THEN array(0, 1) ELSE array(0) END) AS copy")
    late = sent.selectExpr("* EXCEPT (recv_ms)", "recv_ms + element_at(array(0, 5000, 205000, 405000, 90000000), copy + 1) AS recv_ms")
    packets = late.selectExpr(f"(recv_ms - {EPOCH_2024}000) * 8 + copy AS seq", "topic", "payload", "recv_ms")
    landed = stamp(spark, sf_dir, "events")
    if landed not in _LANDED:
        with compiled_methods(spark):
            _LANDED[landed] = scratch_table(packets, "packets")
    return _LANDED[landed]


# the same packets as columns: what a reader of the JSON must find. A packet sent two minutes before its time is taken in
# only when it comes again
MESSAGES_SQL = f"""p AS (SELECT t.* EXCLUDE (seq, recv_ms), t.seq AS event_seq, (t.recv_ms + offset_ms - {EPOCH_2024}000) * 8 + copy AS seq, copy,
    CASE WHEN t.seq % 109 = 0 THEN copy = 3 ELSE copy IN (1, 2) END AND NOT no_time AS repeated, t.recv_ms + offset_ms AS recv_ms, t.seq % 127 > 0 AS topic_ok, t.seq % 131 > 0 AS size_ok,
    t.seq % 101 > 0 AND t.seq % 103 > 0 AS object_ok, t.seq % 113 > 0 AS depth_ok,
    t.seq % 107 > 0 AND (t.seq % 109 > 0 OR copy > 1) AND t.seq % 137 > 0 AND t.seq % 139 > 0 AS time_ok, t.seq % 37 < 4 AS disconnected,
    k % 19 > 0 AS has_kwh,
    CASE WHEN no_time THEN (t.recv_ms + offset_ms) // 1000 ELSE sent_s END AS obs_at
  FROM t, (VALUES (0, 0), (1, 5000), (2, 205000), (3, 405000), (4, 90000000)) c(copy, offset_ms)
  WHERE copy = 0 OR t.seq % 26 = 0 OR copy = 1 AND t.seq % 13 = 0),
q AS (SELECT * FROM p WHERE topic_ok AND size_ok AND object_ok)"""


def _duck_readings() -> str:
    source = "events"
    keep: list[str] = []
    for step in COLUMNS:
        cols = ", ".join([*keep, *[f"{e.format(**_DUCK)} AS {n}" for n, e in step]])
        source = f"(SELECT {cols} FROM {source})"
        keep += [n for n, _ in step]
    return source


READINGS_SQL = f"t AS (SELECT * FROM {_duck_readings()})"
REGISTRY_SQL = """m AS (SELECT c_custkey AS machine_id, 'k' || c_custkey AS api_key,
  CAST(c_nationkey AS BIGINT) AS company_id, CAST(c_nationkey % 5 AS BIGINT) AS plant_id,
  c_name AS machine_serial_no, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FANUC' ELSE 'OTHER' END AS controller_type,
  lower(c_mktsegment) AS cnc_series, c_acctbal >= 0 AS is_active FROM customer)"""
ACTIVE_SQL = "a AS (SELECT * FROM m WHERE is_active AND company_id IS NOT NULL)"
SHIFTS_SQL = f"""s AS (SELECT n_nationkey * 10 + n AS shift_id, CAST(n_nationkey AS BIGINT) AS company_id,
    CASE WHEN {EARLY} AND n = 2 THEN 46800 ELSE b END AS start_s, e AS end_s
  FROM nation, (VALUES (1, 21600, 50400), (2, 50400, 79200), (3, 79200, 21600)) v(n, b, e) WHERE NOT ({NO_NIGHT} AND n = 3))"""
FLEET_SQL = """f AS (SELECT t.*, t.recv_s AS obs_at, t.status_word AS machine_status, t.meter_kwh AS energy,
  a.company_id, a.plant_id, a.controller_type FROM t JOIN a USING (machine_id))"""
FLEET = f"WITH {READINGS_SQL}, {REGISTRY_SQL}, {ACTIVE_SQL}, {SHIFTS_SQL}, {FLEET_SQL}"
