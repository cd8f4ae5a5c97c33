"""The pipeline's stages, each against a plain version over what the stage before kept; and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millwright.llm import queries

from . import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.scratch_table(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    for name in ("quality", "toxicity"):
        before, after = seen[name]
        assert 0.6 * len(before) < len(after) <= len(before) and all(before[r.doc_id] == r.text for r in after)
    before, after = seen["near_duplicates"]
    component, _ = plain.components(list(before), list(before.values()), 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))
    before, after = seen["repeats"]
    ids = sorted(before)
    want = dict(zip(ids, plain.repeats([before[i] for i in ids], 400)))
    assert {r.doc_id for r in after} == set(ids)
    for r in after:
        assert r.n_chars == len(r.text) and want[r.doc_id][1] - 6 * want[r.doc_id][2] <= len(before[r.doc_id].encode()) - len(r.text.encode()) <= want[r.doc_id][1]
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)
    assert max(r.offset + r.length for r in after) <= 2048


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "repeats", "packing"]


def test_topk_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    name = "op2_approximation_file_topk"
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
