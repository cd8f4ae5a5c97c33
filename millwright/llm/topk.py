"""Exact top-k search with vector-approximation files.

A block of the index keeps, beside the exact vectors, a small cell number for every component. For a query the cells
give an upper and a lower bound of every score. Vectors are then read in the order of their upper bounds until the k-th
exact score is above every bound still open; a vector whose bound equals it is still read, as ties go to smaller ids.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.vectors import INDEX_BLOCK, QUERY_BLOCK, blocks_of, packed, search

CELLS = 32  # of each component
QUERIES_AT_ONCE = 128
SCALE = 256.0


def quantised(matrix: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component, as whole numbers."""
    return np.floor(SCALE * matrix)


def _usable(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.isfinite(SCALE * matrix).all(axis=1)


def build_file(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """A block of the approximation file: cells, the edges of the cells, and the exact vectors."""
    whole = quantised(matrix)
    low, high = whole.min(axis=0), whole.max(axis=0)
    step = np.maximum(np.ceil((high - low + 1) / CELLS), 1)
    cells = np.clip(np.floor((whole - low) / step), 0, CELLS - 1).astype(np.uint8)
    # the last cell of a component reaches to its highest value, so that rounding of large numbers cannot leave one out
    bottom = low + np.arange(CELLS)[:, None] * step
    top = np.maximum(bottom + step - 1, np.where(np.arange(CELLS)[:, None] == CELLS - 1, high, -np.inf))
    return pickle.dumps((ids, cells, np.minimum(bottom, high), np.minimum(top, high), whole))


def build_queries(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return pickle.dumps((ids, quantised(matrix)))


def _exact(whole: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in doubles while these are exact, else in Python's integers."""
    if len(whole) and np.abs(whole).max() * max(np.abs(query).max(), 1) * len(query) < 2.0 ** 52:
        return (whole @ query).astype(np.int64)
    own = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, own)) for row in whole], dtype=object)


def answer_block(index_body: bytes, query_body: bytes, k: int) -> tuple[list, list, list]:
    ids, cells, bottom, top, whole = pickle.loads(index_body)
    query_ids, queries = pickle.loads(query_body)
    columns = np.arange(cells.shape[1])
    under, over = bottom[cells, columns], top[cells, columns]
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(query_ids), QUERIES_AT_ONCE):
        part = queries[at:at + QUERIES_AT_ONCE]
        plus, minus = np.maximum(part, 0), np.minimum(part, 0)
        # bounds of large numbers are rounded; a margin far above the rounding keeps them bounds
        margin = 1e-9 * (np.abs(part) @ np.abs(whole).max(axis=0))[:, None]
        margin[margin < 1e-3] = 0
        upper = plus @ over.T + minus @ under.T + margin
        lower = plus @ under.T + minus @ over.T - margin
        for i, query in enumerate(part):
            other = ids != query_ids[at + i]
            floor = np.partition(lower[i][other], -k)[-k] if other.sum() > k else -np.inf
            open_rows = np.flatnonzero(other & (upper[i] >= floor))
            order = open_rows[np.argsort(-upper[i][open_rows], kind="stable")]
            rows, scores, read, size = [], [], 0, 4 * k
            while read < len(order):
                batch = order[read:read + size]
                rows.append(batch)
                scores.append(_exact(whole[batch], query))
                read, size = read + len(batch), size * 2
                if read < len(order) and read >= k and sorted(np.concatenate(scores).tolist())[-k] > upper[i][order[read]]:
                    break
            if rows:
                best = sorted(zip((-s for s in np.concatenate(scores).tolist()), ids[np.concatenate(rows)].tolist()))[:k]
                out[0].extend([int(query_ids[at + i])] * len(best))
                out[1].extend(v for _, v in best)
                out[2].extend(-s for s, _ in best)
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest integer scores among all vectors but its own.

    Both tables have an identifier and a vector. Rows with a null identifier, a null vector, or a null or non-finite
    component take no part; nor do components beyond what doubles can hold when scaled. Vectors meet those of the same
    number of components. Rows that share the query's identifier are its own; a repeated query is answered once; a
    repeated vector counts as often as it stands there. Empty tables give an empty result. Scores must fit a long.
    """
    found, asked = vectors.count(), queries.count()
    index = packed(vectors, id_col, vec_col, INDEX_BLOCK, build_file, _usable, found)
    once = queries.select(id_col, vec_col).dropDuplicates([id_col])
    blocks = packed(once, id_col, vec_col, QUERY_BLOCK, build_queries, _usable, asked)
    return search(index, blocks_of(found, INDEX_BLOCK), blocks, blocks_of(asked, QUERY_BLOCK), lambda a, b: answer_block(a, b, k), "long", k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
