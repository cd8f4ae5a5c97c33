"""Machine status and mode words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words for a running machine and for manual operation
RUN_STATES = ("RUN", "RUNNING", "CUTTING")
MANUAL_STATES = ("MANUAL", "SETUP")


def is_running(status: Column) -> Column:
    return F.coalesce(F.upper(status).isin(*RUN_STATES), F.lit(False))


def is_manual(mode: Column) -> Column:
    return F.coalesce(F.upper(mode).isin(*MANUAL_STATES), F.lit(False))


def machine_status(status: Column) -> Column:
    return F.when(is_running(status), "RUNNING").otherwise("IDLE")


def status_alarm(status: Column) -> Column:
    return F.coalesce(F.upper(status) == "ALARM", F.lit(False))
