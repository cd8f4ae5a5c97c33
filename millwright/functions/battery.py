"""Battery diagnostics of one controller family, and the alarm codes they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.numbers import INT4
from millwright.functions.payload import bind, built_once, trimmed, variants_of
from millwright.params import DEFAULTS

# fixed values: diagnostic bits, code patterns and texts
BITS = {"ABP": 3, "INP": 4, "EXP": 5}
CNC_CODE = "FANUC_CNC_BATTERY"
CODE = r"^FANUC_ACC_([A-Z][A-Z0-9_]{0,7})_(ABP|INP|EXP|LOW)$"
AXIS = r"^[A-Z][A-Z0-9_]{0,7}$"
MEANINGS = {
    "ABP": "A/B phase detector battery voltage is low",
    "INP": "Built-in serial pulse coder battery voltage is low",
    "EXP": "External serial detector battery voltage is low",
    "LOW": "Absolute encoder battery warning is active",
}


def is_battery_code(code: Column) -> Column:
    return F.coalesce((code == CNC_CODE) | code.rlike(CODE), F.lit(False))


def supported(controller_type: Column) -> Column:
    """Decided by the registry, never by what the payload calls itself."""
    return F.coalesce(F.upper(trimmed(controller_type)) == "FANUC", F.lit(False))


def _member(v: Column, key: str) -> tuple[Column, Column]:
    found = F.try_variant_get(v, f"$.{key}", "variant")
    return F.schema_of_variant(found), F.try_variant_get(v, f"$.{key}", "string")


def _flag(v: Column, key: str) -> Column:
    kind, text = _member(v, key)
    boolean = kind == "BOOLEAN"
    return bind(text, lambda t: F.when(((t == "true") & boolean) | (t == "1"), True).when(((t == "false") & boolean) | (t == "0"), False))


def _whole(v: Column, key: str) -> Column:
    _, text = _member(v, key)
    return bind(bind(text, lambda t: F.when(t.rlike(r"^\d+$"), t).try_cast("long")), lambda n: F.when(n <= INT4[1], n))


def _clean(v: Column, key: str, limit: int) -> Column:
    kind, text = _member(v, key)
    plain = lambda t: F.substring(trimmed(F.regexp_replace(t, r"[\x00-\x1f\x7f]", " ")), 1, limit)
    return bind(text, lambda t: F.when(t.isNotNull() & (kind == "STRING"), bind(plain(t), lambda c: F.when(c != "", c))))


def axis_state(v: Column) -> Column:
    """Positive evidence wins; a clear aggregate clears unknown bits; the rest stays unknown."""

    def decide(s):
        bit = lambda n: F.when(s["raw"].isNotNull(), F.bit_get(s["raw"], F.lit(BITS[n])) == 1)
        both = {n: F.when(s[n] | bit(n), True).when((s[n] == False) | (bit(n) == False), False)  # noqa: E712
                for n in BITS}
        any_on = F.coalesce(both["ABP"], F.lit(False)) | F.coalesce(both["INP"], F.lit(False)) | F.coalesce(
            both["EXP"], F.lit(False))
        all_off = both["ABP"].isNotNull() & both["INP"].isNotNull() & both["EXP"].isNotNull() & ~any_on
        low = F.when(any_on, True).otherwise(F.coalesce(s["low"], F.when(all_off, False)))
        settled = {n: F.coalesce(b, F.when(low == False, False)) for n, b in both.items()}  # noqa: E712
        return F.struct(low.alias("low"), s["raw"].alias("raw"), *[b.alias(n) for n, b in settled.items()],
                        s["status"].alias("status"), s["source"].alias("source"))

    told = F.struct(_whole(v, "raw").alias("raw"), _flag(v, "low").alias("low"), *[_flag(v, n).alias(n) for n in BITS],
                    _clean(v, "status", 64).alias("status"), _clean(v, "source", 160).alias("source"))
    return bind(told, decide)


@built_once
def encoder_batteries(fields: Column, p=DEFAULTS) -> Column:
    """Axis -> state for the first valid axes; null without any."""
    entries = F.transform(F.map_entries(variants_of(fields["acc_battery"])), lambda e: F.struct(
        F.upper(trimmed(e["key"])).alias("key"), e["value"].alias("value")))
    valid = F.filter(entries, lambda e: e["key"].rlike(AXIS) & F.startswith(F.schema_of_variant(e["value"]), F.lit("OBJECT")))

    def first_spellings(es):
        keys = F.transform(es, lambda e: e["key"])
        kept = bind(keys, lambda ks: F.filter(es, lambda e, i: F.array_position(ks, e["key"]) == i + 1))
        return F.transform(F.slice(kept, 1, p.max_entries), lambda e: F.struct(e["key"], axis_state(e["value"])))

    return bind(bind(valid, first_spellings), lambda es: F.when(F.size(es) > 0, F.map_from_entries(es)))


@built_once
def controller_warning(fields: Column) -> Column:
    text = fields["cnc_battery_warning"]
    v = F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text))
    return F.when(v.isNotNull(), bind(v, lambda x: F.struct(
        _flag(x, "warning").alias("warning"), _whole(x, "raw_alarm_value").alias("raw_alarm_value"),
        _clean(x, "status", 64).alias("status"), _clean(x, "source", 160).alias("source"))))


def code_states(batteries: Column, warning: Column) -> Column:
    """Battery alarm code -> true / false, for the codes this reading says something about."""

    def of_axis(e):
        s = e["value"]
        specific = F.coalesce(s["ABP"], F.lit(False)) | F.coalesce(s["INP"], F.lit(False)) | F.coalesce(s["EXP"], F.lit(False))
        named = lambda n, state: F.struct(F.concat(F.lit("FANUC_ACC_"), e["key"], F.lit(f"_{n}")).alias("code"),
                                          state.alias("active"))
        return F.array(*[named(n, s[n]) for n in BITS], named("LOW", F.when(specific, False).otherwise(s["low"])))

    none = F.array().cast("array<struct<code:string,active:boolean>>")
    axes = F.coalesce(F.flatten(F.transform(F.map_entries(batteries), of_axis)), none)
    own = F.array(F.struct(F.lit(CNC_CODE).alias("code"), warning["warning"].alias("active")))
    return F.filter(F.concat(axes, own), lambda c: c["active"].isNotNull())


def battery_alarm(code: Column) -> Column:
    axis, bit = F.regexp_extract(code, CODE, 1), F.regexp_extract(code, CODE, 2)
    meaning = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    advice = F.lit(". Arrange a battery inspection.")
    return F.struct(
        code.alias("alarm_code"),
        F.when(code == CNC_CODE, "CNC BATTERY").otherwise("ABSOLUTE ENCODER BATTERY").alias("alarm_type"),
        F.when(code == CNC_CODE, F.concat(F.lit("CNC battery warning is active"), advice)).otherwise(
            F.concat(F.lit("Axis "), axis, F.lit(": "), F.try_element_at(meaning, bit), advice)).alias("alarm_message"),
        F.lit("NORMAL").alias("alarm_severity"))
