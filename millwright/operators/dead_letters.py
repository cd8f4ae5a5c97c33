"""Lines that are no record, and records a table cannot hold: each kept with its reason, the good neighbours go on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.payload import staged
from millwright.params import DEFAULTS, Params

_CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class TableRules:
    """What a table can hold: widths of texts in characters, ranges of numbers (both ends held), columns it must have."""

    table: str
    stage: str
    widths: dict[str, int] = field(default_factory=dict)
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def fault(self) -> Column:
        """Code and column of the first rule a row breaks, null if none: too long, out of range (not a number too), missing."""
        broken = [(F.char_length(c) > n, "22001", c) for c, n in self.widths.items()]
        broken += [(~F.col(c).between(*r) | F.isnan(F.col(c).cast("double")), "22003", c) for c, r in self.ranges.items()]
        broken += [(F.col(c).isNull(), "23502", c) for c in self.required]
        named = lambda code, c: F.struct(F.lit(code).alias("code"), F.lit(c).alias("column"))
        return F.coalesce(*[F.when(test, named(code, c)) for test, code, c in broken], F.lit(None).cast("struct<code:string,column:string>"))


def records_of(lines: DataFrame, schema: str, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(records read by ``schema``, dead letters) of a column ``value`` of NDJSON lines; blank and null lines are neither.

    A line longer than ``max_line_bytes`` is not parsed at all and only its beginning is kept. A line that begins an object and
    does not end it is torn; any other that the schema cannot read is corrupt.
    """
    whole = F.octet_length("value") <= p.max_line_bytes
    read = F.from_json(F.when(whole, F.col("value")), f"{schema}, {_CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = staged(lines.where(F.trim("value") != ""), _whole=whole, _r=read)
    bad = ~F.col("_whole") | F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull()
    cut = F.col("value").startswith("{") & ~F.rtrim("value").endswith("}")
    reason = F.when(~F.col("_whole"), "oversized_record").when(cut, "torn_record").otherwise("corrupt_record")
    start = F.make_valid_utf8(F.substring(F.col("value").cast("binary"), 1, p.max_line_bytes).cast("string"))
    letters = rows.where(bad).select(
        F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("machine_id"), reason.alias("reason"),
        *(F.lit(None).cast("string").alias(c) for c in ("code", "stage", "table", "column")),
        F.when(F.col("_whole"), F.col("value")).otherwise(start).alias("raw"), (~F.col("_whole")).alias("truncated"))
    return rows.where(~bad).select("_r.*").drop(_CORRUPT), letters


def storable(rows: DataFrame, rules: TableRules) -> tuple[DataFrame, DataFrame]:
    """(rows the table can hold, dead letters). ``rows`` have seq and machine_id; the whole row is kept in ``raw``, nulls left out."""
    checked = staged(rows, _fault=rules.fault())
    letters = checked.where(F.col("_fault").isNotNull()).select(
        F.col("seq").cast("long").alias("seq"), F.col("machine_id").cast("long").alias("machine_id"), F.lit("database_rejected").alias("reason"),
        F.col("_fault.code").alias("code"), F.lit(rules.stage).alias("stage"), F.lit(rules.table).alias("table"),
        F.col("_fault.column").alias("column"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("raw"), F.lit(False).alias("truncated"))
    return checked.where(F.col("_fault").isNull()).select(*(F.col(f"`{c}`") for c in rows.columns)), letters
