"""Queries: batches merged into tables kept by day."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millwright.operators import production
from millwright.operators.shifts import shift_calendar
from millwright.plans.catalog import query
from millwright.plans.mapping import FLEET, MAPPED, shifts
from millwright.plans.production import BOOKINGS_SQL, HOURLY_SQL, STEPS, steps_of
from millwright.plans.records import FIELDS, OBS_SQL, flat, merged_sql, observations
from millwright.session import checkpoint_dir, scratch_table
from millwright.sources.day_table import hourly_table, meter_table


def _root(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


@query("hourly_days", f"{STEPS}, {BOOKINGS_SQL} {HOURLY_SQL.format(where='')}")
def hourly_days(spark, d):
    """Older hours, then newer ones, then what some machines add to the newer ones; the second batch comes twice."""
    slices = scratch_table(production.production_slices(steps_of(spark, d), shift_calendar(shifts(spark, d)), MAPPED), "slices")
    newer = F.col("hour_start") >= F.lit(slices.agg(F.expr("(min(hour_start) + max(hour_start)) div 2")).first()[0])
    late = F.col("machine_id") % 10 == F.expr("hour_start div 3600 % 10")
    table = hourly_table(_root(spark, "hourly"))
    for batch, part in ((0, ~newer), (1, newer & ~late), (1, newer & ~late), (2, newer & late)):
        table.upsert(production.production_hourly(slices.where(part)), batch)
    return table.read(spark).withColumn("energy_kwh", F.round("energy_kwh", 6))


@query("meter_days", f"{FLEET}, {OBS_SQL}, {merged_sql('ob', 'mg')} SELECT * REPLACE (read_at * 86400 AS read_at) FROM mg")
def meter_days(spark, d):
    """Observations in two batches along their numbers, the second twice; here a time is the first second of its day."""
    obs = scratch_table(observations(spark, d).withColumn("read_at", F.col("read_at") * 86400), "observations")
    older = F.col("seq") <= F.lit(obs.agg((F.max("seq") / 2).cast("long")).first()[0])
    table = meter_table(_root(spark, "meters"), {n: obs.schema[n].dataType.simpleString() for n in FIELDS})
    for batch, part in ((0, older), (1, ~older), (1, ~older)):
        table.upsert(obs.where(part), batch)
    return flat(table.read(spark))
