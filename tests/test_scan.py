"""Carried scans against a walk over the rows, at chunk widths that split every machine."""

import random

import pytest
from pyspark.sql import functions as F

from millwright.operators.scan import last, peak, prev, scan, top, total


def rows(seed):
    rng = random.Random(seed)
    out, seq = [], 0
    for _ in range(400):
        seq += rng.randint(1, 4)
        out.append((rng.choice([1, 1, 1, 2, 3]), seq, rng.choice([None, *range(12)])))
    return out


def walk(data):
    out = {}
    for key in {r[0] for r in data}:
        mine = sorted(r for r in data if r[0] == key)
        for i, (_, seq, _) in enumerate(mine):
            earlier, later = [r[2] for r in mine[:i]], [r[2] for r in mine[i + 1:]]
            seen = [v for v in earlier if v is not None]
            mark = None
            for v in seen:
                mark = v if mark is None or v <= 2 else max(mark, v)
            ahead = [v for v in later if v is not None]
            out[(key, seq)] = (earlier[-1] if earlier else None, seen[-1] if seen else None, max(seen) if seen else None,
                               sum(seen), mark, ahead[0] if ahead else None)
    return out


@pytest.mark.parametrize("width", [3, 17, 1 << 20])
def test_matches_walk(spark, width):
    data = rows(width)
    df = spark.createDataFrame(data, "m BIGINT, seq BIGINT, v BIGINT")
    v = F.col("v")
    got = scan(df, ["m"], before={"p": prev(v), "l": last(v), "t": top(v), "s": total(v), "k": peak(v, v <= 2)},
               after={"n": last(v)}, width=width).collect()
    assert {(r.m, r.seq): (r.p, r.l, r.t, r.s, r.k, r.n) for r in got} == walk(data)
