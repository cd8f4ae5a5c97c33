"""Lines that are no record and rows a table cannot hold."""

from millwright.operators.dead_letters import TableRules, records_of, storable
from millwright.params import Params

SCHEMA = "s BIGINT, mode STRING"


def test_lines(spark):
    lines = spark.createDataFrame([(v,) for v in (
        '{"s":1,"mode":"AUTO"}', "", "   ", None, '{"s":2,"mo', "x", "[1", '{"s":"a"}', '{"s":3,"mode":"' + "ü" * 60 + '"}', '{"s":4}', '{"s":1,"mode":"AUTO"}')], "value string")
    good, bad = records_of(lines, SCHEMA, Params().with_(max_line_bytes=50))
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "AUTO"), (1, "AUTO"), (4, None)]
    rows = {r.raw: (r.reason, r.truncated) for r in bad.collect()}
    long = next(k for k in rows if "ü" in k)
    assert rows.pop(long) == ("oversized_record", True) and len(long.encode()) <= 52  # a letter cut in two is one replacement
    assert rows == {'{"s":2,"mo': ("torn_record", False), "x": ("corrupt_record", False), "[1": ("corrupt_record", False), '{"s":"a"}': ("corrupt_record", False)}


def test_rows(spark):
    rows = spark.createDataFrame([(1, 1, "AUTO", 5.0), (2, 1, "LONGER", 5.0), (3, 1, "AUTO", 3e9), (4, None, None, None), (5, 1, "ÜÜÜÜ", float("nan")), (6, 2, None, -3.0)],
                                 "seq int, machine_id int, mode string, parts double")
    good, bad = storable(rows, TableRules("t", "write", {"mode": 4}, {"parts": (-3, 10)}, ("machine_id",)))
    assert sorted(r.seq for r in good.collect()) == [1, 6] and good.columns == rows.columns
    assert sorted((r.seq, r.code, r.column, r.table, r.stage) for r in bad.collect()) == [
        (2, "22001", "mode", "t", "write"), (3, "22003", "parts", "t", "write"), (4, "23502", "machine_id", "t", "write"), (5, "22003", "parts", "t", "write")]


def test_empty_and_without_rules(spark):
    none = spark.createDataFrame([], "seq long, machine_id long, mode string")
    good, bad = storable(none, TableRules("t", "write"))
    assert good.count() == bad.count() == 0
    good, bad = records_of(spark.createDataFrame([], "value string"), SCHEMA)
    assert good.count() == bad.count() == 0
