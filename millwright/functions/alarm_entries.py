"""Alarms of a payload: whether it alarms, and every active alarm in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.numbers import lenient_number, truncated
from millwright.functions.payload import bind, block_of, built_once, trimmed

# fixed values: controller type number -> prefix shown on its screen; prefixes that stop a machine
PREFIXES = {0: "SW", 1: "PW", 2: "IO", 3: "PS", 4: "OT", 5: "OH", 6: "SV", 7: "SR", 8: "MC", 9: "SP", 10: "DS",
            11: "IE", 12: "BG", 13: "SN", 15: "EX", 19: "PC"}
STOPPING = ("SV", "SP", "OH")
ALARM = "struct<alarm_code:string,alarm_type:string,alarm_message:string,alarm_severity:string>"


def _nonzero(text: Column) -> Column:
    return F.coalesce(lenient_number(text) != 0, F.lit(False))


def controller_list(fields: Column) -> Column:
    """Entries of the controller's alarm list; null when there is none."""
    return _listed(block_of(fields["pmc_alarm"]))


def _listed(block: Column) -> Column:
    return bind(block["alarms"], lambda text: F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<variant>")))


@built_once
def is_alarming(fields: Column) -> Column:
    listed = lambda block: F.coalesce(F.size(_listed(block)) > 0, F.lit(False))
    told = bind(block_of(fields["pmc_alarm"]), lambda block: _nonzero(block["exist"]) | _nonzero(block["count"]) | listed(block))
    return (_nonzero(fields["stat_alarm"]) | _nonzero(fields["stat_emergency"]) | told
            | F.coalesce(F.upper(fields["machine_status"]) == "ALARM", F.lit(False)))


def _word(entry: Column, key: str) -> Column:
    """A non-blank string member, trimmed."""
    v = F.try_variant_get(entry, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", bind(trimmed(F.try_variant_get(entry, f"$.{key}", "string")), lambda t: F.when(t != "", t)))


def _text(entry: Column, key: str) -> Column:
    return F.try_variant_get(entry, f"$.{key}", "string")


def parse_entry(entry: Column) -> Column:
    """One list entry: an object, or a bare code; null when nothing identifies it."""
    bare = trimmed(F.try_variant_get(entry, "$", "string"))
    none = F.lit(None).cast("string")

    def record(code, alarm_type, message, severity):
        return F.struct(code.alias("alarm_code"), alarm_type.alias("alarm_type"), message.alias("alarm_message"),
                        severity.alias("alarm_severity"))

    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in (str(pair[0]), pair[1])])
    # what is used more than once is worked out once: the type's reading, the number's digits and the axis
    typed = bind(trimmed(_text(entry, "type")), lambda t: F.when(t.isNotNull(), F.struct(
        F.when(t.rlike(r"^\d+$"), F.try_element_at(known, F.regexp_replace(t, "^0+(?=.)", ""))).when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).alias("prefix"),
        F.when((t != "") & ~t.rlike(r"^\d+$") & ~t.rlike("^[A-Za-z]{2}$"), t).alias("type_name"))))
    message = F.coalesce(_word(entry, "message"), _word(entry, "text"), _word(entry, "msg"))
    number = lenient_number(F.coalesce(_text(entry, "number"), _text(entry, "code"), _text(entry, "alarm_no")))
    digits = bind(truncated(F.abs(number)).try_cast("decimal(38,0)").cast("string"), lambda d: F.struct(
        d.alias("plain"), F.when(F.length(d) < 4, F.lpad(d, 4, "0")).otherwise(d).alias("padded")))
    name = bind(_text(entry, "name"), lambda n: F.when(n != "", n))
    axis = bind(lenient_number(_text(entry, "axis")), lambda a: F.struct(
        a.alias("n"), F.when(a % 1 == 0, a.try_cast("long").cast("string")).otherwise(a.cast("string")).alias("text")))

    def parts_of(p):
        prefix = p["typed"]["prefix"]
        code = F.coalesce(_word(entry, "code"), F.when(prefix.isNotNull(), F.concat(prefix, p["digits"]["padded"])).otherwise(p["digits"]["plain"]))
        severity = F.coalesce(_word(entry, "severity"), F.when(prefix.isin(*STOPPING), "CRITICAL"))
        return F.struct(
            prefix.alias("prefix"), p["typed"]["type_name"].alias("type_name"), p["message"].alias("message"), code.alias("code"),
            p["name"].alias("name"), p["axis"]["n"].alias("axis"), p["axis"]["text"].alias("axis_text"), severity.alias("severity"))

    def whole(parts):
        shown = F.when(parts["axis"] > 0, F.concat(parts["message"], F.lit(" (axis "), parts["axis_text"], F.lit(")"))
                       ).otherwise(parts["message"])
        alarm_type = F.coalesce(parts["name"], parts["type_name"], parts["message"],
                                F.concat(parts["prefix"], F.lit(" alarm")))
        named = F.coalesce(parts["code"], parts["message"], parts["type_name"], parts["name"]).isNotNull()
        return F.when(named, record(parts["code"], alarm_type, shown, parts["severity"]))

    read = F.struct(typed.alias("typed"), message.alias("message"), digits.alias("digits"), name.alias("name"), axis.alias("axis"))
    from_object = bind(bind(read, parts_of), whole)
    return bind(F.schema_of_variant(entry), lambda kind: (
        F.when(F.startswith(kind, F.lit("OBJECT")), from_object)
        .when(~F.startswith(kind, F.lit("ARRAY")) & (kind != "VOID"), bind(bare, lambda b: F.when(b != "", record(b, none, none, none))))))


@built_once
def active_alarms(fields: Column, alarming: Column) -> Column:
    """Every active alarm, the payload's own fields first; repeated keys keep their first entry.

    An alarming machine with nothing to name still yields one entry, and an
    emergency stop makes the first one critical.
    """
    said = lambda c: F.when(c != "", c)
    top = F.struct(
        said(trimmed(fields["alarm_code"])).alias("alarm_code"),
        F.coalesce(said(fields["alarm_type"]), said(fields["alarm_name"])).alias("alarm_type"),
        said(fields["alarm_message"]).alias("alarm_message"), said(fields["alarm_severity"]).alias("alarm_severity"))
    named = F.coalesce(top["alarm_code"], top["alarm_type"], top["alarm_message"]).isNotNull()
    none = F.array().cast(f"array<{ALARM}>")
    listed = F.array_compact(F.transform(F.coalesce(controller_list(fields), F.array().cast("array<variant>")), parse_entry))
    every = F.concat(F.when(named, F.array(top)).otherwise(none), listed)

    def distinct(rows):
        keys = F.transform(rows, lambda a: F.coalesce(said(F.coalesce(a["alarm_code"], a["alarm_type"])), F.lit("")))
        return bind(keys, lambda ks: F.filter(
            rows, lambda a, i: (F.get(ks, i) == "") | (F.array_position(ks, F.get(ks, i)) == i + 1)))

    def finished(rows):
        shown = F.when(F.size(rows) == 0, F.array(top)).otherwise(rows)
        stopped = F.transform(shown, lambda a, i: F.when(i == 0, F.struct(
            a["alarm_code"].alias("alarm_code"), F.coalesce(a["alarm_type"], F.lit("EMERGENCY STOP")).alias("alarm_type"),
            a["alarm_message"].alias("alarm_message"), F.lit("CRITICAL").alias("alarm_severity"))).otherwise(a))
        return F.when(_nonzero(fields["stat_emergency"]), stopped).otherwise(shown)

    return F.when(alarming, bind(bind(every, distinct), finished)).otherwise(none)
