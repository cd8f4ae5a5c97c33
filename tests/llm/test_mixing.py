"""Mixing sources: targets against plain water filling, draws, repeated rows and edge cases."""

import os
import random

import pytest

from millwright.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights, ceiling):
    """Targets by source, shared again until none is above its ceiling."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, capped = sum(sizes.values()), set()
    while True:
        left, total = whole - ceiling * sum(sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and w[s] * left > ceiling * sizes[s] * total}
        if not more:
            return {s: ceiling * sizes[s] if s in capped else w[s] * left / total for s in order}
        capped |= more


@pytest.mark.parametrize("seed", range(2))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "z", "Z", "漢"] + [f"s{i}" for i in range(40)]
    sizes = {s: rng.choice([0, 1, 5, 10 ** rng.randrange(1, 13)]) for s in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, mixing.MixParams(rank_rows=7)).collect()}
    want = plain_targets(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 90), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    rows += [(None, "three equal words", None)] * 900 + [(7, None, None), (8, "", "empty"), (9, " \n", "empty")]
    rows += [(10, "long " * 400_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS size", "doc_id AS salt", "1 AS copies", "2 AS s", "3 AS key")
    return df.repartition(6), rows


def test_mix(crowd):
    df, rows = crowd
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows) and {"salt", "s", "key", "text"} <= set(out[0].asDict())
    by = {}
    for r in out:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for source, held in by.items():
        size = sum(r["size"] for r in held)
        assert {r.source_size for r in held} == {size} and len({r.target for r in held}) == 1
        rate = held[0].target / size if size else 0
        assert all(r.copies in (int(rate), int(rate) + 1) for r in held)
        spread = sum(r["size"] ** 2 for r in held) ** 0.5 * (rate % 1 * (1 - rate % 1)) ** 0.5
        assert abs(sum(r["size"] * r.copies for r in held) - held[0].target) <= 4 * spread + 1e-6 * size


def test_runs_agree_whatever_the_partitions(crowd):
    df, _ = crowd
    key = lambda out: sorted((r.doc_id is None, r.doc_id, r.source or "", r["size"], r.copies) if r.doc_id is not None else (True, 0, "", r["size"], r.copies)
                             for r in out.select("doc_id", "source", "size", "copies").collect())
    assert key(mixing.mix_sources(df)) == key(mixing.mix_sources(df.repartition(3, "text"), mixing.MixParams(broadcast_sources=0, salts=5)))


def test_repeated_rows_draw_apart(crowd):
    df, _ = crowd
    alike = [r.copies for r in mixing.mix_sources(df).where("source is null and size > 0").collect()]
    rate = mixing.mix_sources(df).where("source is null").first()
    rate = rate.target / rate.source_size
    assert len(alike) == 900 and (rate % 1 == 0 or len(set(alike)) == 2)


def test_emitted(crowd):
    df, _ = crowd
    mixed = mixing.mix_sources(df)
    assert mixing.emitted(mixed).count() == sum(r.copies for r in mixed.collect())


def test_empty_table(empty):
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op13_source_mix"](spark, SF)
    want = con.execute(queries.ORACLES["op13_source_mix"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
