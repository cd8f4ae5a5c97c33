"""Machine-condition signals: axes, fans, batteries, identity, process values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.numbers import INT2, INT4, INT8, lenient_in_range, lenient_number, temperature, whole_value
from millwright.functions.payload import bind, block_of, built_once, last_wins, trimmed
from millwright.params import DEFAULTS

# fixed values: output column prefix <- accepted keys of the per-axis map, and whether zero means "no sensor"
AXIS_MAPS = (
    ("servo_load", ("servo_axis_load_percent", "servo_load"), False),
    ("servo_temp", ("servo_motor_temperature", "servo_temperature"), True),
    ("encoder_temp", ("encoder_temperature", "encoder_temperatures"), True),
    ("servo_insulation_res", ("servo_motor_insulation_resistance", "servo_insulation_resistance"), False),
    ("servo_pulse", ("servo_pulse_diagnostic",), False),
)
MAIN_AXES = ("X", "Y", "Z")


def first_of(fields: Column, *keys: str) -> Column:
    return F.coalesce(*[fields[k] for k in keys])


def axis_values(text: Column, as_temperature: bool) -> Column:
    """Axis (trimmed, upper case) to number; the last spelling of an axis wins."""
    read = temperature if as_temperature else lenient_number
    return bind(block_of(text), lambda m: F.map_from_entries(last_wins(F.filter(F.transform(
        F.map_entries(m), lambda e: F.struct(F.upper(trimmed(e["key"])).alias("key"), read(e["value"]).alias("value"))),
        lambda e: e["key"] != ""))))


@built_once
def axis_maps(fields: Column) -> dict[str, Column]:
    """One map per signal; stage these before splitting them."""
    return {f"_{name}": axis_values(first_of(fields, *keys), temp) for name, keys, temp in AXIS_MAPS}


@built_once
def axis_columns() -> dict[str, Column]:
    """x, y, z columns per signal and ``extra_axes``: axis -> its signals."""
    out = {f"{name}_{a.lower()}": F.col(f"_{name}")[a] for name, _, _ in AXIS_MAPS for a in MAIN_AXES}
    out["extra_axes"] = extra_axes({name: F.col(f"_{name}") for name, _, _ in AXIS_MAPS})
    return out


def extra_axes(maps: dict[str, Column]) -> Column:
    empty = F.array().cast("array<string>")
    seen = [F.coalesce(F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull() & ~k.isin(*MAIN_AXES))), empty)
            for m in maps.values()]
    axes = F.array_distinct(F.concat(*seen))
    merged = bind(axes, lambda names: F.map_from_arrays(names, F.transform(
        names, lambda a: F.struct(*[m[a].alias(n) for n, m in maps.items()]))))
    return F.when(F.size(axes) > 0, merged)


def flag(text: Column) -> Column:
    """true/1 and false/0 in any spelling of either; else null."""
    word = F.lower(trimmed(text))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def first_entries(m: Column, p=DEFAULTS) -> Column:
    return F.slice(F.map_entries(m), 1, p.max_entries)


def fan_status(text: Column) -> Column:
    """Fan name -> {on, fault, rpm} as reported, or a bare number or word; null without any fan."""

    def one(value):
        return bind(block_of(value), lambda parts: told_of(value, parts))

    def told_of(value, parts):
        is_block = F.startswith(value, F.lit("{"))
        bare = ~is_block & ~F.startswith(value, F.lit("["))
        word = F.substring(trimmed(value), 1, 32)
        return F.struct(
            flag(parts["on"]).alias("on"), flag(parts["fault"]).alias("fault"), lenient_number(parts["rpm"]).alias("rpm"),
            F.when(bare & (word != ""), word).alias("word"))

    fans = F.transform(first_entries(block_of(text)), lambda e: F.struct(
        F.substring(trimmed(e["key"]), 1, 64).alias("key"), one(e["value"]).alias("value")))
    told = lambda e: (e["key"] != "") & F.coalesce(
        e["value"]["on"].isNotNull() | e["value"]["fault"].isNotNull() | e["value"]["rpm"].isNotNull()
        | e["value"]["word"].isNotNull(), F.lit(False))
    return bind(F.filter(fans, told), lambda es: F.when(F.size(es) > 0, F.map_from_entries(last_wins(es))))


def battery_flags(text: Column) -> Column:
    """Axis -> true/false of its absolute-encoder battery; anything else dropped."""
    entries = F.transform(first_entries(block_of(text)), lambda e: F.struct(
        F.substring(F.upper(trimmed(e["key"])), 1, 8).alias("key"), flag(e["value"]).alias("value")))
    kept = F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull())
    return bind(kept, lambda es: F.when(F.size(es) > 0, F.map_from_entries(last_wins(es))))


@built_once
def condition_columns(f: Column) -> dict[str, Column]:
    """Scalar condition columns and the two state maps."""
    return {
        "spindle_speed": lenient_number(f["spindle_speed"]),
        "spindle_motor_temp": temperature(first_of(f, "spindle_motor_temperature", "spindle_temperature")),
        "spindle_insulation_res": lenient_number(f["spindle_insulation_resistance"]),
        "cnc_battery_voltage": lenient_number(f["cnc_battery"]),
        "apc_battery_voltage": lenient_number(f["apc_battery"]),
        "apc_battery_status": battery_flags(f["battery"]),
        "sequence_number": lenient_in_range(first_of(f, "current_sequence_number", "sequence_number"), INT4),
        "fan_status": F.coalesce(fan_status(f["cnc_fans"]), fan_status(f["fans"])),
    }


@built_once
def process_columns(f: Column) -> dict[str, Column]:
    """Process values under their first present spelling; integers kept only inside their column's range."""
    number = lenient_number
    return {
        "cutting_speed": number(first_of(f, "cutting_speed", "surface_speed")),
        "feed_rate": number(f["feed_rate"]),
        "spindle_load": number(f["spindle_load"]),
        "program_number": lenient_in_range(first_of(f, "program_number", "program_no", "o_number"), INT4),
        "total_run_time": lenient_in_range(first_of(f, "total_run_time", "powered_on_time"), INT8),
        "total_cutting_time": lenient_in_range(first_of(f, "total_cutting_time", "cutting_time"), INT8),
        "run_time": lenient_in_range(f["run_time"], INT4),
        "status": whole_value(f["status"], INT2),
        "mode": F.substring(f["mode"], 1, 64),
    }


def identity_columns(f: Column) -> dict[str, Column]:
    """The controller's own identity, cut to the stored widths."""
    told = lambda c, n: F.when(c != "", F.substring(c, 1, n))
    return {
        "controller_ip": told(f["machine_ip"], 45), "cnc_series": told(f["series"], 32),
        "cnc_version": told(f["version"], 32), "cnc_type": F.substring(f["cnc_type"], 1, 16),
        "cnc_machine_type": F.substring(f["machine_type"], 1, 16),
        "controlled_axes": lenient_in_range(f["controlled_axes"], INT4).cast("int"),
    }


def call_results(f: Column) -> Column:
    """Return codes of the collector's calls: an object of at most 8192 characters."""
    text = f["focas_result"]
    return F.when(F.startswith(text, F.lit("{")) & (F.char_length(text) <= 8192), text)
