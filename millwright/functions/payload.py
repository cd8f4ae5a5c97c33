"""Reading drifting JSON: canonical keys, nested blocks, depth, fingerprint.

A payload becomes ``map<string,string>``: scalars as their text, nested values
as their JSON text, in the order sent. Everything is a built-in expression.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: what counts as blank around keys and words
BLANKS = " \t\n\r\f\u000b ﻿  "
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


_BUILT: dict[tuple, object] = {}


def built_once(build):
    """Keeps the columns a function builds, by the text of the columns it is given.

    A reader of a packet is thousands of calls to the JVM, and an unresolved column means the same in every plan, so a
    session builds each reader once and not once for every micro-batch. Only for functions of unresolved columns.
    """
    @wraps(build)
    def built(*args, **named):
        said = lambda v: str(v) if isinstance(v, Column) else v
        key = (build.__module__, build.__name__, tuple(map(said, args)), tuple((k, said(v)) for k, v in sorted(named.items())))
        if key not in _BUILT:
            _BUILT[key] = build(*args, **named)
        return _BUILT[key]

    return built


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _wrapped(payload: Column, value_type: str) -> Column:
    # inside an array, trailing garbage or a second value is a parse error instead of being ignored
    rows = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), f"array<map<string,{value_type}>>", _STRICT)
    return bind(rows, lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))))


@built_once
def object_of(payload: Column) -> Column:
    """Top-level keys of a JSON object; null for anything else."""
    return _wrapped(payload, "string")


def block_of(text: Column) -> Column:
    """A nested JSON object's keys, of a repeated one the last value; null when the value is not an object."""
    return F.when(F.startswith(text, F.lit("{")), bind(F.from_json(text, "map<string,string>", _STRICT), lambda m: F.when(
        repeats(F.map_keys(m)), F.map_from_entries(last_wins(F.map_entries(m)))).otherwise(m)))


def repeats(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) < F.size(keys)


def variants_of(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,variant>", _STRICT))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    A plain projection would be substituted into every filter above it and
    parsed again there. A generator over one struct is not: later filters and
    projections read its output.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def last_wins(entries: Column) -> Column:
    """Entries with a repeated key reduced to its last one."""
    return bind(entries, lambda es: bind(
        F.reverse(F.transform(es, lambda e: e["key"])),
        lambda back: F.filter(es, lambda e, i: F.array_position(back, e["key"]) == F.size(back) - i)))


@built_once
def canonical(fields: Column) -> Column:
    """Trimmed lower-case keys; the exactly lower-case spelling wins, else the first; blank keys dropped."""

    def renamed(m):
        named = F.transform(F.map_entries(m), lambda e: F.struct(
            F.lower(trimmed(e["key"])).alias("key"), e["value"].alias("value"), e["key"].alias("raw")))
        # exact spellings stand last (repeats keep their last); drifting ones before them, the first nearest the end
        return bind(named, lambda es: last_wins(F.transform(F.concat(
            F.reverse(F.filter(es, lambda e: (e["raw"] != e["key"]) & (e["key"] != ""))),
            F.filter(es, lambda e: (e["raw"] == e["key"]) & (e["key"] != ""))),
            lambda e: F.struct(e["key"], e["value"]))))

    # keys that stay apart need no order among them, which costs more than all the rest
    apart = lambda ks: ~F.array_contains(ks, "") & ~repeats(ks)
    return bind(fields, lambda m: bind(F.transform(F.map_keys(m), lambda k: F.lower(trimmed(k))), lambda ks: F.when(
        apart(ks), F.map_from_arrays(ks, F.map_values(m))).otherwise(F.map_from_entries(renamed(m)))))


@built_once
def depth_ok(payload: Column, limit: int) -> Column:
    """No value lies deeper than ``limit`` (the object itself is depth 0).

    One pass takes out text literals, empty containers (values like any other) and all that is no bracket; what is left
    are the brackets of containers that hold something, nested at most ``limit`` deep.
    """
    opened = F.octet_length(payload) - F.octet_length(F.replace(F.replace(payload, F.lit("["), F.lit("")), F.lit("{"), F.lit("")))
    brackets = F.regexp_replace(payload, r'''"(?:[^"\\]++|\\.)*+"|[\[{][,\s]*+[\]}]|[^\[\]{}"]++|"''', "")
    nested = ""
    for _ in range(limit):
        nested = rf"(?:[\[{{]{nested}[\]}}])*+"
    return F.when(opened <= limit, True).otherwise(brackets.rlike(f"^{nested}$"))


@built_once
def fingerprint(payload: Column, missing_time: Column | None = None) -> Column:
    """SHA-256 over the canonical object with keys sorted at every level.

    ``missing_time`` is added as ``time`` when the payload has none. Numbers are told apart by value, texts by every
    character. An object that repeats a key below the top has no such form; there the values are compared as they were
    sent, so that no object is without a fingerprint.
    """

    def sorted_text(fields, time):
        """JSON of the fields by key, with the missing time where there is none."""
        def written(keys, values):
            order = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
            return bind(order, lambda o: F.to_json(F.map_from_arrays(
                F.transform(o, lambda e: e["k"]), F.transform(o, lambda e: F.get(values, e["i"])))))

        keys, values = F.map_keys(fields), F.map_values(fields)
        if time is None:
            return written(keys, values)
        return F.when(F.array_contains(keys, "time") | time.isNull(), written(keys, values)).otherwise(
            written(F.concat(keys, F.array(F.lit("time"))), F.concat(values, F.array(time))))

    # a whole text is one match, however long, and stays; of a number outside texts the zeros after the last fraction digit go
    number = r'''("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<=\d)(?:\.0+|(\.\d*[1-9])0+)(?=[,}\]]|$)'''
    shortened = lambda t: F.when(t.rlike(r"\.\d*0(?:[,}\]]|$)"), F.regexp_replace(t, number, "$1$2")).otherwise(t)
    told = lambda kind: None if missing_time is None else missing_time.cast(kind)
    by_value = bind(bind(canonical(_wrapped(payload, "variant")), lambda m: sorted_text(m, told("variant"))), shortened)
    as_sent = bind(canonical(object_of(payload)), lambda m: F.concat(F.lit("as sent "), sorted_text(
        F.transform_values(m, lambda k, v: F.coalesce(v, F.lit("null"))), told("string"))))
    return F.sha2(F.coalesce(by_value, as_sent), 256)
