"""Whitening against a plain fit over every row, whatever repeats, is null, long, large or flat."""

import os

import numpy as np
import pytest

from millwright.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=8):
    """By place of the row: (deviation, whitened up to sign, explained), and the sizes of the fit; of one length."""
    use = [(i, v) for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in use], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    z = centred @ vectors[:, order] / np.sqrt(values[order])
    return [i for i, _ in use], n, deviation, z, values[order] / np.trace(cov)


def check(spark, rows, out, components):
    at, n, deviation, z, explained = plain(rows, components)
    got = {}
    for r in out:
        assert r.n == n and r.identity_error <= 1e-4 and abs(r.explained / explained[r.component - 1] - 1) < 1e-8
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    want = {}
    for i, dev, line in zip(at, deviation, z):
        want.setdefault((rows[i][0], dev), []).append(line)
    assert got.keys() == want.keys()
    signs = np.zeros(z.shape[1])
    for key, lines in want.items():
        own = np.array([w for _, w in sorted(got[key])]).reshape(z.shape[1], -1).T
        assert len(own) == len(lines)
        for k in range(z.shape[1]):
            if not signs[k] and abs(lines[0][k]) > 0.1:
                signs[k] = np.sign(own[0][k] * lines[0][k])
    for key, lines in want.items():
        own = np.array([w for _, w in sorted(got[key])]).reshape(z.shape[1], -1).T
        assert np.allclose(np.sort(own, axis=0), np.sort(np.array(lines) * signs, axis=0), rtol=1e-8, atol=1e-8)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(12, 12)) * np.linspace(0.2, 3, 12)
    out = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(500, 12)) @ spread)]
    out += [(1000 + i, out[3][1]) for i in range(400)] + [(5, out[5][1])] * 3 + [(None, out[9][1])]  # a vector that a third of the rows hold
    return out + [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] * 12), (2005, [1e300] * 12)]


@pytest.mark.parametrize("hot", [1000, 2])
def test_whitening(spark, rows, hot):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS weight", "'x' AS xs", "3 AS dim").repartition(4)
    out = whitening.whiten(df, whitening.WhitenParams(hot=hot)).drop("embedding")
    assert sorted(out.columns) == sorted(["vec_id", "weight", "xs", "dim", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    check(spark, rows[:-1], out.collect(), 8)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * i) * 1e9, -float(i), 0.5 * (i % 3)]) for i in range(40)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).drop("embedding").collect()
    _, _, deviation, _, _ = plain(rows)
    want = dict(zip(range(40), deviation))
    assert len(out) == 120 and all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2 ** 63 else None) for r in out)
    assert any(want[i] >= 2 ** 63 for i in want)


def test_lengths_apart_and_no_variance(spark):
    rows = [(i, [float(i % 5), float(i % 7)]) for i in range(70)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(4)] + [(200, [7.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    check(spark, rows[:70], out.where("vec_id < 100").collect(), 2)
    flat = out.where("vec_id >= 100").collect()
    assert len(flat) == 13 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in flat)


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.QUERIES["op11_multiplicity_whitening"](spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(spark, rows, out.collect(), 8)
