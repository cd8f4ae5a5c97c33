"""Stored form of alarm texts: code-point limits, keys of over-long names, severity classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.payload import trimmed

# fixed values: stored widths, and severities by class
NAME_LIMIT, SEVERITY_LIMIT, DIGEST = 50, 20, 16
CRITICAL = ("CRITICAL", "FATAL", "EMERGENCY")
INFO = ("INFO", "INFORMATION", "INFORMATIONAL", "LOW", "MESSAGE")


def key_within(text: Column, limit: int = NAME_LIMIT) -> Column:
    """The text, or its beginning and a digest when it does not fit."""
    short = F.concat(F.substring(text, 1, limit - DIGEST - 1), F.lit("~"), F.substring(F.sha2(text, 256), 1, DIGEST))
    return F.when(F.char_length(text) <= limit, text).otherwise(short)


def alarm_fields(alarm_type: Column, code: Column, message: Column, severity: Column) -> dict[str, Column]:
    kind = F.when(alarm_type != "", alarm_type).otherwise("UNSPECIFIED")
    stored_code = key_within(code)
    cut = F.substring(kind, 1, NAME_LIMIT)
    stored_type = F.when(code.isNull(), key_within(kind)).otherwise(cut)
    lost = F.array(
        F.when(stored_type != kind, F.concat(F.lit("Alarm type: "), kind)),
        F.when(stored_code != code, F.concat(F.lit("Alarm code: "), code)),
        F.when(message != "", message))
    details = F.array_join(F.array_compact(lost), "\n")
    return {
        "alarm_type": stored_type, "alarm_code": stored_code,
        "severity": stored_severity(severity),
        "message": F.when(details != "", details),
        "alarm_key": F.coalesce(stored_code, stored_type),
    }


def stored_severity(severity: Column) -> Column:
    level = F.upper(trimmed(severity))
    return F.substring(F.coalesce(F.when(level != "", level), F.lit("NORMAL")), 1, SEVERITY_LIMIT)


def severity_class(severity: Column) -> Column:
    level = F.upper(trimmed(severity))
    return F.when(level.isin(*CRITICAL), "critical").when(level.isin(*INFO), "info").otherwise("noncritical")
