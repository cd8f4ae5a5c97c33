"""Lenient and strict number readers, and electrical quantities with units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.payload import bind, trimmed

INT2 = (-32_768, 32_767)
INT4 = (-2_147_483_648, 2_147_483_647)
INT8 = (-9_007_199_254_740_991, 9_007_199_254_740_991)

# fixed values: what a number and a quantity look like
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_PLAIN = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
_WHOLE = r"^([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)$"
_QUANTITY = r"^([+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z]+)?$"
_LARGEST = 1.7976931348623157e308

# fixed values: how a unit becomes the canonical one
ENERGY_UNITS = {"wh": ("divide", 1000), "kwh": ("multiply", 1), "mwh": ("multiply", 1000)}
POWER_UNITS = {"w": ("divide", 1000), "kw": ("multiply", 1), "mw": ("multiply", 1000)}


def _read(text: Column, digits, body) -> Column:
    """``body(number)`` for the finite number in ``digits(text)``; nothing is evaluated for a null text.

    Text without a match yields '', which no cast accepts.
    """
    return F.when(text.isNotNull(), bind(digits(text).try_cast("double"), lambda n: F.when(
        n.between(-_LARGEST, _LARGEST), body(n))))


def _same(n: Column) -> Column:
    return n


def _leading(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, r"^([^,]*),", "$1."), _PREFIX, 1)


def lenient_number(text: Column) -> Column:
    """The number a text begins with, its first comma read as a decimal point."""
    return _read(text, _leading, _same)


def truncated(x: Column) -> Column:
    """Whole part, toward zero, still a double."""
    return x - x % 1


def lenient_int(text: Column) -> Column:
    return _read(text, _leading, lambda n: truncated(n).try_cast("long"))


def lenient_in_range(text: Column, bounds: tuple[int, int]) -> Column:
    """The leading number truncated toward zero when it fits the column, else null."""
    return _read(text, _leading, lambda n: in_range(n, bounds))


def temperature(text: Column) -> Column:
    """Zero and below mean that there is no sensor."""
    return _read(text, _leading, lambda n: F.when(n > 0, n))


def strict_number(text: Column, unsigned: bool = False) -> Column:
    """A complete finite number; text around it makes it unreadable."""
    digits = lambda t: F.translate(F.regexp_extract(trimmed(t), _WHOLE, 1), ",", ".")
    return _read(text, digits, (lambda n: F.when(n >= 0, n)) if unsigned else _same)


def plain_number(text: Column) -> Column:
    """A complete finite number with a decimal point."""
    return _read(text, lambda t: F.regexp_extract(trimmed(t), _PLAIN, 1), _same)


def strict_count(text: Column) -> Column:
    """Whole number 0..2147483647, from a number or numeric text."""
    return _read(text, lambda t: F.regexp_extract(trimmed(t), _PLAIN, 1),
                 lambda n: F.when((n >= 0) & (n <= INT4[1]) & (n % 1 == 0), n.cast("long")))


def in_range(n: Column, bounds: tuple[int, int]) -> Column:
    """Truncated toward zero when it fits the column, else null."""
    low, high = bounds
    return F.when((n > low - 1) & (n < high + 1) & (F.abs(n) <= INT8[1]), truncated(n).cast("long"))


def whole_value(text: Column, bounds: tuple[int, int]) -> Column:
    """The value as a whole: a number, a text that is one and nothing else, or true (1) and false (0); truncated, in range, else null."""
    word = trimmed(text)
    bare = F.when(word == "true", "1").when(word == "false", "0").when((word == "") & (text != ""), "0").otherwise(word)
    return in_range(plain_number(bare), bounds)


def _unit_key(unit: Column) -> Column:
    # a lower-case m is milli, never mega
    u = trimmed(unit)
    return F.when(~F.startswith(u, F.lit("m")), F.lower(u))


def quantity(text: Column, units: dict[str, tuple[str, int]], canonical: str, unsigned: bool,
             unit: Column | None = None, unit_given: Column | bool = False) -> Column:
    """A complete quantity in the canonical unit, or null.

    ``unit`` is explicit metadata; when given it must be known and agree with
    any suffix.
    """
    given = F.lit(unit_given) if isinstance(unit_given, bool) else unit_given
    known = list(units)
    known_word = lambda c: F.coalesce(c.isin(*known), F.lit(False))

    def scaled(q):
        used = F.when(q["suffixed"], q["suffix"]).when(q["given"], q["explicit"]).otherwise(F.lit(canonical))
        value = F.when(used == canonical, q["n"])
        for name, (operation, by) in units.items():
            if name != canonical:
                value = value.when(used == name, q["n"] / by if operation == "divide" else q["n"] * by)
        agrees = (~q["suffixed"] | known_word(q["suffix"])) & (~q["given"] | known_word(q["explicit"])) & (
            ~q["suffixed"] | ~q["given"] | F.coalesce(q["suffix"] == q["explicit"], F.lit(False)))
        readable = q["n"].between(-_LARGEST, _LARGEST) & ((q["n"] >= 0) if unsigned else F.lit(True))
        fits = lambda v: F.when(v.between(-_LARGEST, _LARGEST) & ((v != 0) | (q["n"] == 0)), F.when(v == 0, 0.0).otherwise(v))
        return F.when(readable & agrees, bind(value, fits))

    def parts(t):
        written = F.regexp_extract(t, _QUANTITY, 2)
        return F.struct(
            F.translate(F.regexp_extract(t, _QUANTITY, 1), ",", ".").try_cast("double").alias("n"),
            (written != "").alias("suffixed"), _unit_key(written).alias("suffix"), given.alias("given"),
            _unit_key(unit if unit is not None else F.lit(None).cast("string")).alias("explicit"))

    return F.when(text.isNotNull(), bind(parts(trimmed(text)), scaled))


def energy_quantity(text: Column, unit: Column | None = None, unit_given: Column | bool = False) -> Column:
    """Cumulative energy in kWh, never negative."""
    return quantity(text, ENERGY_UNITS, "kwh", True, unit, unit_given)


def power_quantity(text: Column, unit: Column | None = None, unit_given: Column | bool = False) -> Column:
    """Active power in kW with its sign."""
    return quantity(text, POWER_UNITS, "kw", False, unit, unit_given)
