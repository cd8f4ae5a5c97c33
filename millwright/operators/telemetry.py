"""A parsed packet as one row of the telemetry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import battery, meter, signals
from millwright.functions.alarm_entries import is_alarming
from millwright.functions.numbers import INT4, in_range, strict_count
from millwright.functions.payload import bind, staged
from millwright.functions.status import machine_status


def telemetry_rows(parsed: DataFrame) -> DataFrame:
    """The 47 stored columns of accepted snapshots.

    ``parsed`` holds fields, power, energy_data, time_s, recv_ms, machine_id,
    company_id, plant_id, controller_type.
    """
    f = F.col("fields")
    own = battery.supported(F.col("controller_type"))
    read = staged(
        parsed, **signals.axis_maps(f),
        **{f"_e_{k}": v for k, v in meter.electrical_signals(f, F.col("power"), F.col("energy_data")).items()},
        **{f"_s_{k}": v for k, v in {**signals.condition_columns(f), **signals.process_columns(f)}.items()},
        alarm=is_alarming(f), acc_battery_status=F.when(own, battery.encoder_batteries(f)),
        cnc_battery_warning=F.when(own, battery.controller_warning(f)))
    s = lambda name: F.col(f"_s_{name}").alias(name)
    e = lambda name: F.col(f"_e_{name}").alias(name)
    axes = signals.axis_columns()
    low = F.map_filter(F.transform_values("acc_battery_status", lambda k, v: v["low"]), lambda k, v: v.isNotNull())
    flags = bind(low, lambda m: F.when(F.size(m) > 0, m).otherwise(F.col("_s_apc_battery_status")))
    return read.select(
        "seq", "company_id", "plant_id", "machine_id", machine_status(f["machine_status"]).alias("machine_status"), "alarm",
        s("status"), strict_count(f["parts_count"]).alias("parts_count"), s("spindle_load"), s("feed_rate"),
        s("cutting_speed"), s("total_run_time"), s("total_cutting_time"), s("run_time"), s("program_number"),
        F.col("time_s").cast("long").alias("device_time"), s("mode"), e("energy"),
        F.timestamp_millis("recv_ms").alias("received_at"), e("voltage"), e("current"), e("power"),
        in_range(F.col("_s_spindle_speed"), INT4).alias("spindle_speed"), s("spindle_motor_temp"), s("spindle_insulation_res"),
        *[axes[n].alias(n) for n in axes if n != "extra_axes"], s("cnc_battery_voltage"), s("apc_battery_voltage"),
        s("sequence_number"), s("fan_status"), axes["extra_axes"].alias("extra_axes"), flags.alias("apc_battery_status"),
        "acc_battery_status", "cnc_battery_warning")
