"""Data quality: range guard, rows a table cannot hold, quarantine summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.numbers import INT2, INT4, INT8, truncated
from millwright.functions.payload import staged
from millwright.params import DEFAULTS, Params

# fixed values: integer columns of the telemetry table and what they can hold
RANGES = {"status": INT2, "parts_count": INT4, "total_run_time": INT8, "total_cutting_time": INT8, "run_time": INT4,
          "program_number": INT4, "spindle_speed": INT4, "sequence_number": INT4}
# fixed values: reasons, and the text fields counted per table
REASONS = ("database_rejected", "corrupt_record", "torn_record", "oversized_record")
ALARM_TEXTS = (("alarm_type", "alarm_type"), ("alarm_code", "alarm_code"), ("severity", "alarm_severity"),
               ("message", "alarm_message"))


def guard(value: Column, column: str) -> Column:
    """The value truncated toward zero when its column can hold it, else null."""
    t = truncated(value)
    return F.when(t.between(*RANGES[column]), t.cast("long"))


def range_violations(rows: DataFrame, columns: list[str], p: Params = DEFAULTS) -> DataFrame:
    """One report per machine, column and time window, with the first offending value.

    Rows: machine_id, recv_ms, and the raw columns, numbers or texts; what cannot be read as a number is reported too.
    """
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("value"), F.col(c).cast("string").alias("sent"),
                                (F.col(c).isNotNull() & guard(F.col(c).try_cast("double"), c).isNull()).alias("bad")) for c in columns])
    window = (F.floor(F.col("recv_ms") / (p.range_window_s * 1000)) * p.range_window_s).cast("long")
    bad = rows.select("machine_id", "seq", window.alias("window_start"), F.explode(checks).alias("_v")).where("_v.bad")
    return bad.groupBy("machine_id", F.col("_v.column").alias("column"), "window_start").agg(
        F.count("*").alias("violations"), F.min_by(F.col("_v.value"), "seq").alias("first_value"), F.min_by(F.col("_v.sent"), "seq").alias("first_sent"))


def split_storable(rows: DataFrame, limits: dict[str, int], not_null: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows the table can hold, dead letters with code and column).

    ``limits`` are text widths in characters; ``not_null`` columns are required.
    """
    faults = F.array_compact(F.array(
        *[F.when(F.char_length(c) > n, F.struct(F.lit("22001").alias("code"), F.lit(c).alias("column"))) for c, n in limits.items()],
        *[F.when(F.col(c).isNull(), F.struct(F.lit("23502").alias("code"), F.lit(c).alias("column"))) for c in not_null]))
    checked = rows.withColumn("_fault", F.get(faults, F.lit(0)))
    good = checked.where(F.col("_fault").isNull()).drop("_fault")
    bad = checked.where(F.col("_fault").isNotNull()).select(
        *rows.columns, F.lit("database_rejected").alias("reason"), F.col("_fault.code").alias("code"),
        F.col("_fault.column").alias("column"))
    return good, bad


def longest_texts(rejected: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Longest text per rejected batch and field, in characters; never the text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.char_length(c).cast("long").alias("n")) for c in columns])
    return rejected.select(batch, F.explode(pairs).alias("_t")).where("_t.n IS NOT NULL").groupBy(
        batch, F.col("_t.field").alias("field")).agg(F.max("_t.n").alias("longest"))


def _path(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _id(text: Column) -> Column:
    n = F.when(text.rlike(r"^[1-9]\d*$"), text).try_cast("long")
    return F.when(n <= INT8[1], n)


def _word(doc: Column, path: str, pattern: str) -> Column:
    text = _path(doc, path)
    return F.when(text.rlike(pattern), text)


def parse_quarantine(lines: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lines (pos, value) with ``state``: blank, oversized, malformed or record, and the parsed ``doc``."""
    # inside an array a line with trailing text does not parse
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    sized = F.octet_length("value") <= p.max_line_bytes
    doc = F.when(sized & F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))
    opened = staged(lines, doc=doc)
    state = (F.when(~sized, "oversized").when(F.trim("value") == "", "blank").when(F.col("doc").isNull(), "malformed")
             .otherwise("record"))
    return staged(opened, state=state)


def quarantine_summary(parsed: DataFrame) -> DataFrame:
    """Ids, reason, safe names and text lengths per dead letter; values never leave it."""
    d = F.col("doc")
    first = lambda *paths: _id(F.coalesce(*[_path(d, x) for x in paths]))
    safe = "^[A-Za-z_][A-Za-z_0-9]{0,63}$"
    reason = _path(d, "$.reason")
    field = lambda table, column, path: F.struct(
        F.lit(table).alias("table"), F.lit(column).alias("column"), F.char_length(_path(d, path)).cast("long").alias("characters"),
        F.lit(None).cast("int").alias("alarm_index"))
    opens = F.try_variant_get(d, "$.record.a.opens", "array<variant>")
    of_alarm = F.flatten(F.transform(F.coalesce(opens, F.array().cast("array<variant>")), lambda a, i: F.array(*[F.struct(
        F.lit("machine_alarms").alias("table"), F.lit(c).alias("column"),
        F.char_length(F.try_variant_get(a, f"$.{k}", "string")).cast("long").alias("characters"), i.alias("alarm_index")) for c, k in ALARM_TEXTS])))
    row = lambda name: first(f"$.record.r.{name}", f"$.record.l.{name}", f"$.record.a.{_camel(name)}",
                             f"$.record.m.{_camel(name)}", f"$.record.gap.{name}")
    texts = F.concat(F.array(
        field("telemetry_raw", "machine_status", "$.record.r.machine_status"), field("telemetry_raw", "mode", "$.record.r.mode"),
        field("telemetry_late", "reason", "$.record.l.reason"), field("ingest_gaps", "reason", "$.record.gap.reason")), of_alarm)
    at = _word(d, "$.at", r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z$")
    summary = dict(
        quarantined_at=F.when(at.try_cast("timestamp").isNotNull(), at),
        sequence=_id(_path(d, "$.record.s")), machine_id=row("machine_id"), company_id=row("company_id"),
        device_time=first("$.record.r.device_time", "$.record.l.device_time"),
        reason=F.when(reason.isin(*REASONS), reason).otherwise("unclassified"),
        sqlstate=_word(d, "$.code", "^[A-Z0-9]{5}$"), stage=_word(d, "$.stage", safe),
        table=_word(d, "$.table", safe), column=_word(d, "$.column", safe),
        text_fields=F.filter(texts, lambda t: t["characters"].isNotNull()))
    return staged(parsed.where("state = 'record'").select("pos", "doc"), **summary).drop("doc")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def quarantine_counts(parsed: DataFrame) -> DataFrame:
    return parsed.where("state <> 'blank'").groupBy("state").agg(F.count("*").alias("lines"))


def quarantine_list(summary: DataFrame, seq: int | None = None, machine: int | None = None, limit: int = 10) -> DataFrame:
    """The first ``limit`` (1..100) matching records in file order."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    hits = summary
    if seq is not None:
        hits = hits.where(F.col("sequence") == seq)
    if machine is not None:
        hits = hits.where(F.col("machine_id") == machine)
    return hits.orderBy("pos").limit(limit)
