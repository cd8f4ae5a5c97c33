"""Approximate nearest neighbours by largest inner product, with a vantage-point tree per shard.

One more component, sqrt(M * M - |x| * |x|) with M the longest vector of the shard, gives all its vectors the same length; among
those the largest inner product is the smallest distance, and distances obey the triangle inequality. A tree node
splits its vectors at the median distance from a vantage point and keeps the nearest and farthest distance of each
half. A leaf's vectors are at least max(d - farthest, nearest - d) away from a query at distance d from the vantage
point. A leaf is left out if ``factor`` times that bound is beyond the k-th distance found: one is exact search, more
leaves out more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.vectors import INDEX_BLOCK, QUERY_BLOCK, blocks_of, packed, search, vector_arrays

FACTORS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.2)
RECALL = 0.97  # on the sample that the factor is chosen by
SAMPLE_QUERIES = 128
LEAF = 64
STEP = 8  # leaves that a query visits before it looks at its k-th distance again
QUERIES_AT_ONCE = 256
_SLACK = 1e-7  # of squared lengths; far above the rounding of the distances


def usable(matrix: np.ndarray) -> np.ndarray:
    """Rows with a length above zero, whose square a double can hold."""
    with np.errstate(over="ignore", under="ignore"):
        square = np.square(matrix).sum(axis=1)
    return np.isfinite(square) & (np.abs(matrix).max(axis=1) > 0)


def build_tree(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """Leaves as runs of reordered vectors; for each leaf its ancestors' vantage points and its distances from them."""
    square = np.square(matrix).sum(axis=1)
    longest = square.max()
    point = np.column_stack((matrix, np.sqrt(np.maximum(longest - square, 0))))
    leaves, vantage, todo = [], [], [(np.argsort(ids, kind="stable"), [])]
    while todo:
        rows, above = todo.pop()
        if len(rows) <= LEAF:
            leaves.append((rows, above))
            continue
        # the row farthest from the mean spreads the distances well
        centre = rows[np.argmax(np.square(point[rows] - point[rows].mean(axis=0)).sum(axis=1))]
        distance = np.sqrt(np.square(point[rows] - point[centre]).sum(axis=1))
        order = np.argsort(distance, kind="stable")
        half, v = len(rows) // 2, len(vantage)
        vantage.append(centre)
        for side in (order[:half], order[half:]):
            todo.append((rows[side], [*above, (v, distance[side[0]], distance[side[-1]])]))
    order = np.concatenate([rows for rows, _ in leaves])
    starts = np.cumsum([0] + [len(rows) for rows, _ in leaves])
    return pickle.dumps((ids[order], matrix[order], float(longest), matrix[vantage], starts, [above for _, above in leaves]))


def build_queries(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return pickle.dumps((ids, matrix))


def _bounds(queries: np.ndarray, longest: float, vantage: np.ndarray, leaves: list) -> np.ndarray:
    """Lower bound of the distance from every query to every leaf."""
    out = np.zeros((len(queries), len(leaves)))
    if len(vantage):
        own = np.square(queries).sum(axis=1)[:, None] + longest
        slack = _SLACK * own
        square = own - 2 * queries @ vantage.T
        near, far = np.sqrt(np.maximum(square - slack, 0)), np.sqrt(np.maximum(square + slack, 0))
        tiny = _SLACK * np.sqrt(longest)
        for i, above in enumerate(leaves):
            for v, low, high in above:
                np.maximum(out[:, i], np.maximum(near[:, v] - high, low - far[:, v]) - tiny, out=out[:, i])
    return out


def answer_block(index_body: bytes, query_body: bytes, k: int, factor: float) -> tuple[list, list, list]:
    ids, matrix, longest, vantage, starts, leaves = pickle.loads(index_body)
    query_ids, queries = pickle.loads(query_body)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(query_ids), QUERIES_AT_ONCE):
        part, own = queries[at:at + QUERIES_AT_ONCE], query_ids[at:at + QUERIES_AT_ONCE]
        lowest = _bounds(part, longest, vantage, leaves)
        visits = np.argsort(lowest, axis=1, kind="stable")
        reach = np.square(part).sum(axis=1) + longest
        score = np.full((len(part), len(ids)), -np.inf)
        going, farthest = np.arange(len(part)), np.full(len(part), np.inf)
        for r in range(0, len(leaves), STEP):
            if not len(going):
                break
            turn = visits[going, r:r + STEP]
            for leaf in np.unique(turn):
                who = going[(turn == leaf).any(axis=1)]
                a, b = starts[leaf], starts[leaf + 1]
                product = part[who] @ matrix[a:b].T
                product[ids[a:b] == own[who, None]] = -np.inf
                score[who, a:b] = product
            if len(ids) > k:
                kth = np.partition(score[going], -k, axis=1)[:, -k]
                farthest[going] = np.where(np.isfinite(kth), np.sqrt(np.maximum(reach[going] - 2 * kth + _SLACK * reach[going], 0)), np.inf)
            if r + STEP < len(leaves):
                going = going[factor * lowest[going, visits[going, r + STEP]] <= farthest[going]]
        for i in range(len(part)):
            seen = score[i]
            kth = np.partition(seen, -k)[-k] if len(ids) > k else -np.inf
            # scores of one matrix product may differ in the last place for equal vectors: take all near the k-th, then sum each row alike
            rows = np.flatnonzero((seen >= kth - 1e-9 * reach[i]) & (seen > -np.inf))
            exact = np.einsum("ij,j->i", matrix[rows], part[i])
            best = sorted(zip((-exact).tolist(), ids[rows].tolist()))[:k]
            out[0].extend([int(own[i])] * len(best))
            out[1].extend(v for _, v in best)
            out[2].extend(-s for s, _ in best)
    return out


def chosen_factor(vectors: DataFrame, k: int, id_col: str, vec_col: str) -> float:
    """The largest of ``FACTORS`` that keeps ``RECALL`` of the exact result, measured on a tree of a bounded sample, else 1.

    How far bounds can be trusted depends on the vectors. The sample is a block of the index and as many queries as
    ``SAMPLE_QUERIES``, by a hash of the identifier.
    """
    drawn = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).orderBy(F.xxhash64("id"), "id").limit(INDEX_BLOCK).toArrow().combine_chunks()
    columns = [drawn.column(c).combine_chunks() if drawn.column(c).num_chunks else pa.array([], drawn.column(c).type) for c in ("id", "vec")]
    groups = sorted(vector_arrays(*columns, usable), key=lambda g: -len(g[0]))
    if not groups or len(groups[0][0]) <= k:
        return 1.0
    ids, matrix = groups[0]
    tree, asked = build_tree(ids, matrix), build_queries(ids[:SAMPLE_QUERIES], matrix[:SAMPLE_QUERIES])

    def answers(factor: float) -> set:
        return set(zip(*answer_block(tree, asked, k, factor)[:2]))

    exact = answers(1.0)
    return next((f for f in FACTORS if len(answers(f) & exact) >= RECALL * len(exact)), 1.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found by inner product among all vectors but its own.

    Rows with a null identifier or vector, a null or non-finite component, or length zero take no part. Vectors meet
    those of the same number of components. Rows that share the query's identifier are its own; a repeated query is
    answered once; a repeated vector counts as often as it stands there. Empty tables give an empty result. With
    ``factor`` 1 the result is exact, ties to the smaller identifier; without one it is chosen by a measured sample.
    """
    factor = factor or chosen_factor(vectors, k, id_col, vec_col)
    found, asked = vectors.count(), queries.count()
    index = packed(vectors, id_col, vec_col, INDEX_BLOCK, build_tree, usable, found)
    once = queries.select(id_col, vec_col).dropDuplicates([id_col])
    blocks = packed(once, id_col, vec_col, QUERY_BLOCK, build_queries, usable, asked)
    return search(index, blocks_of(found, INDEX_BLOCK), blocks, blocks_of(asked, QUERY_BLOCK), lambda a, b: answer_block(a, b, k, factor), "double", k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
