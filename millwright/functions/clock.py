"""Local hour and second of day at a fixed offset from UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.params import DEFAULTS


def hour_start(epoch_s: Column, offset: int = DEFAULTS.zone_offset_s) -> Column:
    shifted = epoch_s + F.lit(offset)
    return (F.floor(shifted / 3600) * 3600 - offset).cast("long")


def second_of_day(epoch_s: Column, offset: int = DEFAULTS.zone_offset_s) -> Column:
    """Seconds after local midnight; a fraction of a second is kept."""
    return F.pmod(epoch_s + F.lit(offset), F.lit(86_400))


def time_to_seconds(text: Column) -> Column:
    """``HH:MM[:SS[.f]]`` to seconds after midnight, whole seconds rounded down; null without a readable hour."""
    parts = F.split(text, ":")
    hours = F.get(parts, F.lit(0)).try_cast("int")
    minutes = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    seconds = F.coalesce(F.floor(F.get(parts, F.lit(2)).try_cast("double")).try_cast("int"), F.lit(0))
    return hours * 3600 + minutes * 60 + seconds
