"""Electrical readings of a payload: the four headline signals and the 52 meter columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.numbers import (INT4, energy_quantity, power_quantity, strict_number, truncated)
from millwright.functions.payload import bind, block_of, built_once, canonical

# fixed values: stored column <- lower-cased key of the meter block
FIELDS = (
    ("v1n", "voltage_v1n"), ("v2n", "voltage_v2n"), ("v3n", "voltage_v3n"), ("v_ln_avg", "average_voltage_ln"),
    ("v12", "voltage_v12"), ("v23", "voltage_v23"), ("v31", "voltage_v31"), ("v_ll_avg", "average_voltage_ll"),
    ("i1", "current_i1"), ("i2", "current_i2"), ("i3", "current_i3"), ("i_avg", "average_current"),
    ("kw1", "kw1"), ("kw2", "kw2"), ("kw3", "kw3"), ("kw_total", "total_kw"),
    ("kvar1", "kvar1"), ("kvar2", "kvar2"), ("kvar3", "kvar3"), ("kvar_total", "total_kvar"),
    ("kva1", "kva1"), ("kva2", "kva2"), ("kva3", "kva3"), ("kva_total", "total_kva"),
    ("pf1", "pf1"), ("pf2", "pf2"), ("pf3", "pf3"), ("pf_avg", "average_pf"), ("frequency_hz", "frequency"),
    ("kw_demand_max", "active_power_max_demand"), ("kw_demand_min", "active_power_min_demand"),
    ("kvar_demand_max", "reactive_power_max_demand"), ("kvar_demand_min", "reactive_power_min_demand"),
    ("kva_demand_max", "apparent_power_max_demand"),
    ("v1n_max", "maximum_voltage_v1n"), ("v2n_max", "maximum_voltage_v2n"), ("v3n_max", "maximum_voltage_v3n"),
    ("v12_max", "maximum_voltage_v12"), ("v23_max", "maximum_voltage_v23"), ("v31_max", "maximum_voltage_v31"),
    ("i1_max", "maximum_current_i1"), ("i2_max", "maximum_current_i2"), ("i3_max", "maximum_current_i3"),
    ("kwh_import", "import_active_energy_kwh"), ("kwh_export", "export_active_energy_kwh"),
    ("kwh_total", "total_active_energy_kwh"),
    ("kvarh_import", "import_reactive_energy_kvarh"), ("kvarh_export", "export_reactive_energy_kvarh"),
    ("kvarh_total", "total_reactive_energy_kvarh"), ("kvah_total", "total_apparent_energy_kvah"),
    ("run_hours", "run_hour"), ("aux_interrupts", "auxiliary_interrupts"),
)
NAMES = tuple(c for c, _ in FIELDS)
# fixed values: top-level keys that carry electrical data, and those that only accompany it
ELECTRICAL_KEYS = ("powerdata", "power_data", "energy", "energyformatted", "energy_formatted", "energydata",
                   "energy_data", "energy_unit", "power_unit", "voltage", "volts", "current", "amps", "amperes",
                   "power", "kw")
TRANSPORT_KEYS = ("time", "machine_ip", "connection")

_FLOAT_MAX = (2 - 2**-23) * 2.0**127
_FLOAT_MIN = 2.0**-149


def is_cumulative(column: str) -> bool:
    return column.split("_")[0] in ("kwh", "kvarh", "kvah") or column == "run_hours"


def is_unsigned(column: str) -> bool:
    measured = re.fullmatch(r"(v|i)\d.*|v_l[nl]_avg|i_avg|kva(\d|_total|_demand_max)", column)
    return bool(measured) or is_cumulative(column) or column == "aux_interrupts"


def spark_type(column: str) -> str:
    return "int" if column == "aux_interrupts" else "double" if is_cumulative(column) else "float"


def _named_block(top: Column, first: str, second: str) -> Column:
    return canonical(F.coalesce(block_of(top[first]), block_of(top[second])))


@built_once
def power_block(top: Column) -> Column:
    return _named_block(top, "powerdata", "power_data")


@built_once
def energy_block(top: Column) -> Column:
    return _named_block(top, "energydata", "energy_data")


def _float_range(x: Column) -> Column:
    size = F.abs(x)
    return F.when((size <= _FLOAT_MAX) & ((size == 0) | (size >= _FLOAT_MIN)), x)


def _first(candidates: list[Column], read) -> Column:
    """The first candidate that reads as valid."""
    return F.get(F.array_compact(F.transform(F.array(*candidates), read)), F.lit(0))


def _as_quantity(text: Column, unit: Column, given: Column | bool) -> Column:
    given = F.lit(given) if isinstance(given, bool) else given
    return F.struct(text.alias("text"), unit.alias("unit"), given.alias("given"))


def _candidates(top: Column, power: Column, energy: Column) -> dict[str, Column]:
    e_unit, e_given = top["energy_unit"], F.map_contains_key(top, F.lit("energy_unit"))
    p_unit, p_given = top["power_unit"], F.map_contains_key(top, F.lit("power_unit"))
    kwh = [_as_quantity(top[k], e_unit, e_given) for k in ("energy", "energyformatted", "energy_formatted")]
    kwh += [_as_quantity(energy[k], F.lit(u), True)
            for k, u in (("total_kwh", "kWh"), ("total_wh", "Wh"), ("total_mwh", "MWh"))]
    kwh += [_as_quantity(energy["value"], energy["unit"], True),
            _as_quantity(power["total_active_energy_kwh"], F.lit("kWh"), True)]
    kw = [_as_quantity(power["total_kw"], F.lit("kW"), True), _as_quantity(top["power"], p_unit, p_given),
          _as_quantity(top["kw"], F.lit("kW"), True)]
    volts = [power["average_voltage_ll"], top["voltage"], top["volts"]]
    amps = [power["average_current"], top["current"], top["amps"], top["amperes"]]
    return {
        "kwh_total": _first(kwh, lambda c: energy_quantity(c["text"], c["unit"], c["given"])),
        "v_ll_avg": _first(volts, lambda t: strict_number(t, True)),
        "i_avg": _first(amps, lambda t: strict_number(t, True)),
        "kw_total": _first(kw, lambda c: power_quantity(c["text"], c["unit"], c["given"])),
    }


@built_once
def electrical_signals(top: Column, power: Column, energy: Column) -> dict[str, Column]:
    """energy, voltage (line to line only), current and power: first valid spelling wins."""
    c = _candidates(top, power, energy)
    return {out: c[column] for out, column in
            (("energy", "kwh_total"), ("voltage", "v_ll_avg"), ("current", "i_avg"), ("power", "kw_total"))}


def _readers() -> list[tuple[list[str], object]]:
    """Meter columns grouped by how their text is read; the four with several spellings are apart."""
    several = ("kwh_total", "v_ll_avg", "i_avg", "kw_total")
    plain = [c for c in NAMES if c not in several]
    energy = [c for c in plain if c.startswith("kwh_")]
    power = [c for c in plain if re.fullmatch(r"kw(\d|_demand_\w+)", c)]
    registers = [c for c in plain if is_cumulative(c) and c not in energy]
    rest = [c for c in plain if c not in energy + power + registers + ["aux_interrupts"]]
    whole = lambda t: bind(truncated(strict_number(t, True)), lambda n: F.when(n <= INT4[1], n))
    return [
        (energy, lambda t: energy_quantity(t, F.lit("kWh"), True)),
        (power, lambda t: bind(power_quantity(t, F.lit("kW"), True), _float_range)),
        (registers, lambda t: strict_number(t, True)),
        ([c for c in rest if is_unsigned(c)], lambda t: bind(strict_number(t, True), _float_range)),
        ([c for c in rest if not is_unsigned(c)], lambda t: bind(strict_number(t), _float_range)),
        (["aux_interrupts"], whole),
    ]


def _texts(power: Column, columns: list[str]) -> Column:
    keys = dict(FIELDS)
    return F.array(*[power[keys[c]] for c in columns])


def _multi(top: Column, power: Column, energy: Column) -> dict[str, Column]:
    c = _candidates(top, power, energy)
    return {n: v if n == "kwh_total" else bind(v, _float_range) for n, v in c.items()}


@built_once
def meter_columns(top: Column, power: Column, energy: Column) -> dict[str, Column]:
    """Arrays of readings per group of columns, and the four columns with several spellings.

    Feed the result to ``staged`` and then to ``meter_fields``.
    """
    out = {f"_meter_{i}": F.transform(_texts(power, columns), reader)
           for i, (columns, reader) in enumerate(_readers())}
    return {**out, **{f"_meter_{n}": v for n, v in _multi(top, power, energy).items()}}


@built_once
def meter_fields() -> dict[str, Column]:
    """The 52 columns in table order, from the columns of ``meter_columns``."""
    found = {n: F.col(f"_meter_{n}") for n in ("kwh_total", "v_ll_avg", "i_avg", "kw_total")}
    for i, (columns, _) in enumerate(_readers()):
        found.update({c: F.col(f"_meter_{i}")[j] for j, c in enumerate(columns)})
    return {n: found[n].cast(spark_type(n)) for n in NAMES}


@built_once
def any_readable(top: Column, power: Column, energy: Column) -> Column:
    """At least one of the 52 columns can be read."""

    def found(columns, reader):
        return F.exists(_texts(power, columns), lambda t: reader(t).isNotNull())

    groups = [found(columns, reader) for columns, reader in _readers()]
    result = F.coalesce(*_multi(top, power, energy).values()).isNotNull()
    for g in groups:
        result = result | F.coalesce(g, F.lit(False))
    return result


@built_once
def has_electrical_keys_only(top: Column) -> Column:
    allowed = ELECTRICAL_KEYS + TRANSPORT_KEYS
    return F.forall(F.map_keys(top), lambda k: k.isin(*allowed))
