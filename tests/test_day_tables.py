"""Batches merged into tables kept by day: what is rewritten, and that nothing counts twice."""

import os

import pytest

from millwright.sources.day_table import hourly_table

DAY = 86_400
COLUMNS = "machine_id long, shift_id long, hour_start long, company_id long, run_seconds long, idle_seconds long, manual_seconds long, produced_qty long, energy_kwh double"


def files(root):
    return {d: sorted(f for f in os.listdir(os.path.join(root, d)) if f.startswith("part-")) for d in os.listdir(root) if d.startswith("day=")}


def batch(spark, *rows):
    return spark.createDataFrame([(m, 1, at, 7, parts, 0, 0, parts, float(parts)) for m, at, parts in rows], COLUMNS).repartition(4)


def test_only_touched_days_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "hourly")
    table = hourly_table(root)
    assert table.read(spark).count() == 0
    assert table.upsert(batch(spark, (1, 0, 5), (1, 3600, 2), (1, DAY, 3), (2, 9 * DAY, 1)), 0) == [0, 1, 9]
    before = files(root)
    assert all(len(f) == 1 for f in before.values())  # four partitions of the batch, one file a day
    second = batch(spark, (1, DAY, 4), (3, DAY + 3600, 6), (1, 20 * DAY, 8))
    assert table.upsert(second, 1) == [1, 20]
    after = files(root)
    assert after["day=0"] == before["day=0"] and after["day=9"] == before["day=9"] and after["day=1"] != before["day=1"]
    assert table.upsert(second, 1) == [] and files(root) == after  # the same batch again
    got = sorted((r.machine_id, r.hour_start, r.produced_qty, r.energy_kwh) for r in table.read(spark).collect())
    assert got == [(1, 0, 5, 5.0), (1, 3600, 2, 2.0), (1, DAY, 7, 7.0), (1, 20 * DAY, 8, 8.0), (2, 9 * DAY, 1, 1.0), (3, DAY + 3600, 6, 6.0)]


def test_a_batch_cut_off_goes_on_with_its_other_days(spark, tmp_path):
    table = hourly_table(str(tmp_path / "hourly"))
    table.upsert(batch(spark, (1, 0, 1), (1, DAY, 1)), 0)
    table.upsert(batch(spark, (1, 0, 10)), 1)  # as far as the first try came
    assert table.upsert(batch(spark, (1, 0, 10), (1, DAY, 10)), 1) == [1]
    assert sorted((r.hour_start, r.produced_qty) for r in table.read(spark).collect()) == [(0, 11), (DAY, 11)]


def test_empty_batches_and_rows_without_a_time(spark, tmp_path):
    table = hourly_table(str(tmp_path / "hourly"))
    assert table.upsert(batch(spark, (1, 0, 1)).where("false"), 0) == []
    with pytest.raises(ValueError):
        table.upsert(batch(spark, (1, None, 1)), 1)
    table.upsert(batch(spark, (1, -3600, 1)), 2)
    assert table.read(spark).count() == 1


def test_tasks_that_add_batches_up_grow_with_the_rows(spark):
    from pyspark.sql import functions as F

    from millwright.operators import production
    from millwright.session import dealt, scratch_table
    row = "id % 50 as machine_id, id % 3 as shift_id, id div 9 * 3600 as hour_start, 7L as company_id, 10L as run, 5L as idle, 1L as manual, 2L as produced, 0.5D as energy"
    slices = scratch_table(spark.range(3000).selectExpr(*row.split(", ")), "slices")
    even = F.col("produced") + F.col("hour_start") % 7 > 4
    spread = dealt(slices, ["machine_id", "shift_id", "hour_start"], 100)
    merged = production.merge_hourly(*(production.production_hourly(spread.where(part)) for part in (even, ~even)))
    held = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 20 and max(held) < 300  # thirty tasks, not the session's four
    assert sorted(merged.collect()) == sorted(production.production_hourly(slices).collect())
