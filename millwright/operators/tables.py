"""Latest states, restart baselines, tenant back-fill, replay and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.scan import prev, scan
from millwright.params import DEFAULTS, Params


def latest_per_machine(rows: DataFrame, time: str, now_s: int, columns: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Newest row per machine inside the look-back (ties: the higher seq)."""
    recent = rows.where((F.col(time) > now_s - p.lookback_s) & (F.col(time) <= now_s))
    newest = F.max_by(F.struct(*columns), F.struct(time, "seq"))
    return recent.groupBy("machine_id").agg(newest.alias("_n")).select("machine_id", "_n.*")


def bootstrap_baseline(machines: DataFrame, telemetry: DataFrame, energy: DataFrame, battery_codes: DataFrame,
                       now_s: int, p: Params = DEFAULTS) -> DataFrame:
    """What a machine restarts from: last telemetry, last positive energy, open battery codes."""
    t = latest_per_machine(telemetry, "recv_s", now_s, ["parts_count", "machine_status", "mode", "device_time"], p)
    positive = energy.where((F.col("energy") > 0) & (F.col("observed_at") <= now_s) & (F.col("recv_s") > now_s - p.lookback_s))
    e = positive.groupBy("machine_id").agg(F.max_by(
        F.struct(F.col("energy").alias("energy_meter"), F.col("observed_at").alias("energy_meter_at"),
                 F.when(F.col("standalone"), F.col("observed_at")).alias("energy_standalone_at")),
        F.struct("observed_at", "seq")).alias("_e")).select("machine_id", "_e.*")
    joined = machines.select("machine_id").join(t, "machine_id", "left").join(e, "machine_id", "left").join(
        battery_codes, "machine_id", "left")
    return joined.where(F.coalesce("device_time", "energy_meter_at").isNotNull() | (F.size("codes") > 0))


def tenant_backfill(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """Null company ids filled from the machine row."""
    owner = machines.select("machine_id", F.col("company_id").alias("_owner"))
    return rows.join(owner, "machine_id", "left").withColumn(
        "company_id", F.coalesce("company_id", "_owner")).drop("_owner")


def tenant_null_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows without a company, per table."""
    counts = [df.agg(F.count_if(F.col("company_id").isNull()).alias("missing")).select(F.lit(n).alias("table"), "missing")
              for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def skip_replayed(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records beyond what their collector has already committed."""
    known = records.join(checkpoints.select("collector_id", "last_seq"), "collector_id", "left")
    return known.where(F.col("seq") > F.coalesce("last_seq", F.lit(0))).drop("last_seq")


def advance_checkpoints(records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints after the batch: never lower than before."""
    offered = records.groupBy("collector_id").agg(F.max("seq").alias("_offered"))
    return checkpoints.join(offered, "collector_id", "full").select(
        "collector_id", F.greatest("last_seq", "_offered").alias("last_seq"))


def insert_missing(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*key), key, "left_anti")


def gap_rows(stored: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gap records not stored yet, as rows of their table: its key is the collector and that collector's journal number.

    ``gaps`` also have collector_id and recv_ms; a collector sends no number twice, another one may send the same.
    """
    rows = gaps.withColumnRenamed("seq", "journal_seq").withColumn("received_at", F.timestamp_millis("recv_ms")).drop("recv_ms")
    return insert_missing(stored, rows, ["collector_id", "journal_seq"])


def retained(rows: DataFrame, received_s: str, now_s: int, keep_s: int) -> DataFrame:
    return rows.where(F.col(received_s) >= now_s - keep_s)


def latest_state(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("machine_id").agg(F.max_by(F.struct("seq", *columns), "seq").alias("_n")).select("machine_id", "_n.*")


def live_state(rows: DataFrame, columns: list[str], now_s: int, p: Params = DEFAULTS) -> DataFrame:
    """Latest accepted state per machine, gone after the time to live without a refresh."""
    return latest_state(rows, ["recv_s", *columns]).where(F.col("recv_s") > now_s - p.live_ttl_s).withColumnRenamed(
        "recv_s", "ingested_at")


def payload_sample(rows: DataFrame, now_s: int, p: Params = DEFAULTS) -> DataFrame:
    """Last accepted payload per machine and aligned window, inside the retention."""
    window = F.expr(f"recv_s div {p.sample_window_s} * {p.sample_window_s}")
    kept = rows.where(F.col("recv_s") >= now_s - p.sample_retention_s)
    return kept.groupBy("machine_id", window.alias("window_start")).agg(
        F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def identity_changes(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows whose identity and return codes differ from the machine's previous ones."""
    s = scan(rows, ["machine_id"], before={"_old": prev(F.struct("identity", "focas"))}, width=p.chunk_seqs)
    same = (F.col("_old")["identity"].eqNullSafe(F.col("identity"))) & F.col("_old")["focas"].eqNullSafe(F.col("focas"))
    return s.where(F.col("_old").isNull() | ~same).drop("_old")


def identity_update(machines: DataFrame, seen: DataFrame, columns: list[str]) -> DataFrame:
    """Machine rows with each identity column at its newest supplied value, else as stored."""
    newest = seen.groupBy("machine_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns],
        F.max("recv_s").alias("_seen"))
    joined = machines.join(newest, "machine_id", "left")
    keep = [c for c in machines.columns if c not in (*columns, "controller_seen_at")]
    seen = F.coalesce("_seen", "controller_seen_at") if "controller_seen_at" in machines.columns else F.col("_seen")
    return joined.select(*keep, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], seen.alias("controller_seen_at"))


def batch_stats(rows: DataFrame, batch: str) -> DataFrame:
    """Per batch: rows, late rows, bad rows, and how long receipt took."""
    return rows.groupBy(batch).agg(
        F.count("*").alias("rows"), F.count_if("late").alias("late_rows"), F.count_if("bad").alias("bad_records"),
        (F.max("recv_ms") - F.min("recv_ms")).alias("span_ms"))
