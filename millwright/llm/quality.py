"""Quality classifier: supervised subword embeddings.

Every word and character n-gram of a text has a learned vector in a hashed table; a document is their average, and a
softmax layer on it gives the classes. Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. The layer is linear in the average, so scoring needs only one number per bucket:
its vector's share of the difference of the two logits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.arrays import runs, text_bytes
from millwright.llm.features import counted, quality_groups, summed


@dataclass(frozen=True)
class QualityParams:
    bits: int = 17  # the table has 2 ** bits vectors
    dims: int = 8
    sample: int = 3_000  # labelled rows to train on, at most; chosen by a hash of their identifier
    epochs: int = 4
    least_steps: int = 12_000  # a small sample is gone over more often
    rate: float = 4.0
    seed: int = 7
    threshold: float = 0.3  # from this score on a document is kept


DEFAULTS = QualityParams()
PARTS = 16  # tasks that make the features of a sample


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label columns) of at most ``limit`` labelled documents; ``labels`` has the identifier and label columns."""
    names = [c for c in labels.columns if c != id_col]
    here = docs.select(F.col(id_col).alias("here_id"))  # labels of documents that are not here must not use up the limit
    chosen = labels.join(here, F.col(id_col) == F.col("here_id"), "left_semi").dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(limit)
    chosen = chosen.select(F.col(id_col).alias("labelled_id"), F.struct(*names).alias("labels"))
    # at most `limit` rows of an identifier and its labels: a bounded broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    return found.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(limit).select("id", "text", "labels.*")


def sampled_features(sample: DataFrame, groups, bits: int, names: list[str]) -> tuple[list, np.ndarray]:
    """Features of the sampled texts, made on the executors: ([(buckets, shares)], label matrix) in a fixed order."""

    def features(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in runs(offsets):
                count = b - a
                doc, bucket, times, total = counted(groups(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bits), count)
                cut = np.searchsorted(doc, np.arange(count + 1))
                share = (times / np.maximum(total[doc], 1)).astype(np.float32) if len(doc) else np.zeros(0, np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, count), pa.array([bucket[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                     pa.array([share[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())]
                    + [batch.column(n).slice(a, count) for n in names], ["id", "buckets", "shares", *names])

    schema = f"id {sample.schema['id'].dataType.simpleString()}, buckets binary, shares binary, " + ", ".join(f"{n} int" for n in names)
    # a limit leaves one partition: dealt out, the features reach the driver in small pieces, not as one task's result
    made = sample.repartition(PARTS, "id").mapInArrow(features, schema).toArrow()
    ids = [str(i) for i in made.column("id").to_pylist()]
    # arrays over the Arrow buffers themselves: the driver's Python holds the sample's features once
    buckets, shares = ([np.frombuffer(v.as_buffer(), t) for v in made.column(c)] for c, t in (("buckets", np.int32), ("shares", np.float32)))
    alike = groupby(sorted(range(len(ids)), key=ids.__getitem__), key=ids.__getitem__)
    order = [i for _, same in alike for i in sorted(same, key=lambda i: buckets[i].tobytes())]
    marks = np.array([[v or 0 for v in made.column(n).to_pylist()] for n in names], dtype=np.int64).reshape(len(names), len(ids)).T
    return [(buckets[i], shares[i]) for i in order], marks[order]


def train(examples: list, labels: np.ndarray, params: QualityParams = DEFAULTS) -> tuple[np.ndarray, float]:
    """(logit share of each bucket, logit of a text without features). One or no class gives its smoothed prior."""
    rng = np.random.default_rng(params.seed)
    count = np.bincount(labels, minlength=2)[:2] + 1.0
    prior = float(np.log(count[1] / count[0]))
    table = rng.uniform(-1 / params.dims, 1 / params.dims, (1 << params.bits, params.dims)).astype(np.float32)
    layer, bias = np.zeros((2, params.dims), np.float32), np.array([0.0, prior], np.float32)
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << params.bits), prior
    epochs = max(params.epochs, -(-params.least_steps // len(examples)))
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rate = params.rate * (1 - step / steps)
            step += 1
            bucket, share = examples[i]
            if not len(bucket):
                continue
            hidden = share @ table[bucket]
            logits = layer @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = layer.T @ error
            layer -= rate * 0.1 * np.outer(error, hidden)
            bias -= rate * 0.01 * error
            table[bucket] -= np.float32(rate) * share[:, None] * back
    return (table @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], params: QualityParams = DEFAULTS, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the probability of class 1. Null and empty texts get the score of no features."""
    weights, bias = model
    kept = [c for c in docs.columns if c.lower() != score.lower()]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** bits numbers whatever the data
    bits = params.bits

    def scored(batches):
        table = shared.value[:, None]
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            found = np.zeros(batch.num_rows)
            for a, b in runs(offsets):
                total, n = summed(quality_groups(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bits), table, b - a)
                found[a:b] = total[:, 0] / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-(found + bias))))], [*batch.schema.names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score}` double"
    return docs.mapInArrow(scored, schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the rows that are never trained on: their identifier's checksum is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """A model from the labelled rows that are not held out. Without any, every score is one half."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(id_col)).select(id_col, F.col("quality").cast("int").alias("quality"))
    examples, marks = sampled_features(labelled_sample(docs, usable, params.sample, id_col, text_col), quality_groups, params.bits, ["quality"])
    return train(examples, marks[:, 0], params)


def keep_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = DEFAULTS) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they had; a null text scores as an empty one."""
    scored = score_texts(docs, train_quality(docs, labels, params), params, score="__quality_score")
    return scored.where(F.col("__quality_score") >= params.threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
