"""Vectors packed into blocks, and every pair of a query block and an index block brought together once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_BLOCK = 8_192  # vectors of one block of the index
QUERY_BLOCK = 1_024  # queries of one block


def vector_arrays(ids: pa.Array, vectors: pa.Array, usable: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(identifiers, matrix) by number of components; leaves out nulls, null or non-finite components and rows that ``usable`` refuses."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], dtype=np.int64)
    named = np.array([i is not None for i in ids.to_pylist()], dtype=bool)
    for dim in sorted(set(lengths[lengths > 0].tolist())):
        rows = np.flatnonzero((lengths == dim) & named)
        flat = vectors.take(pa.array(rows)).flatten()
        matrix = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        good = np.isfinite(matrix).all(axis=1)
        good[good] = usable(matrix[good])
        if good.any():
            yield ids.take(pa.array(rows[good])).cast(pa.int64()).to_numpy(), matrix[good]


def packed(vectors: DataFrame, id_col: str, vec_col: str, size: int, build: Callable[[np.ndarray, np.ndarray], bytes],
           usable: Callable[[np.ndarray], np.ndarray], rows: int) -> DataFrame:
    """Rows (part, dim, body) that hold at most ``size`` vectors each, as ``build`` packs them; ``rows`` is the table's count."""
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).repartition(max(1, math.ceil(rows / size)))

    def pack(batches):
        part, pending = TaskContext.get().partitionId(), {}
        for batch in batches:
            for ids, matrix in vector_arrays(batch.column("id"), batch.column("vec"), usable):
                pending.setdefault(matrix.shape[1], []).append((ids, matrix))
        for dim, pieces in pending.items():
            ids, matrix = (np.concatenate(x) for x in zip(*pieces))
            for at in range(0, len(ids), size):
                body = build(ids[at:at + size], matrix[at:at + size])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([body], pa.binary())], ["part", "dim", "body"])

    return narrow.mapInArrow(pack, "part int, dim int, body binary")


def search(index: DataFrame, index_parts: int, queries: DataFrame, query_parts: int, answer: Callable[[bytes, bytes], tuple], kind: str, k: int) -> DataFrame:
    """The ``k`` best answers of every query over all blocks: highest score first, ties to the smaller identifier.

    Each block is sent to the blocks of the other side, so a task holds two blocks at a time whatever the tables' size. The
    join is a merge join by name: a side's size is guessed before its blocks are repeated, so a guess of a few megabytes
    would bring hundreds of them to the driver to be broadcast.
    """
    left = index.select("dim", F.col("part").alias("ip"), F.col("body").alias("index_body"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("qp"))
    right = queries.select(F.col("dim").alias("qdim"), F.col("part").alias("qpart"), F.col("body").alias("query_body"),
                           F.explode(F.sequence(F.lit(0), F.lit(index_parts - 1))).alias("ipart"))
    pairs = left.join(right.hint("merge"), (F.col("dim") == F.col("qdim")) & (F.col("ip") == F.col("ipart")) & (F.col("qp") == F.col("qpart")))

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("index_body"), batch.column("query_body")):
                query, vec, score = answer(a.as_py(), b.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.select("index_body", "query_body").mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def blocks_of(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))
