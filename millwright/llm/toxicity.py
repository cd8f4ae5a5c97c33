"""Toxicity: a classifier chain over hashed word features.

Categories are predicted one after another. Each has a linear model over the selected features and the probabilities
of all earlier categories; those come from out-of-fold predictions while it is trained, so that it learns how far they
can be trusted, and from the earlier models while it scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.arrays import runs, text_bytes
from millwright.llm.features import toxicity_groups
from millwright.llm.quality import held_out, labelled_sample, sampled_features

CATEGORIES = ("insult_en", "insult_de", "insult_fr", "insult_es", "toxic")  # the last is the decision


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    sample: int = 8_000  # labelled rows to train on, at most; chosen by a hash of their identifier
    per_category: int = 64  # features with the strongest sign of a category
    least_z: float = 6.0  # of a selected feature's excess among the category's documents
    least_documents: int = 4
    folds: int = 3
    rounds: int = 400
    ridge: float = 1e-4
    threshold: float = 0.3


DEFAULTS = ToxicityParams()


def select_features(examples: list, marks: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Buckets that a category's documents hold more often than the others do, beyond chance."""
    chosen: set[int] = set()
    size, n = 1 << params.bits, len(examples)
    overall = np.zeros(size)
    for bucket, _ in examples:
        overall[bucket] += 1
    for c in range(marks.shape[1]):
        ones = int(marks[:, c].sum())
        if not 0 < ones < n:
            continue
        inside = np.zeros(size)
        for i in np.flatnonzero(marks[:, c]):
            inside[examples[i][0]] += 1
        share = overall / n
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (n - ones)))
        z = (inside / ones - (overall - inside) / (n - ones)) / spread
        z[(inside < params.least_documents) | (z < params.least_z)] = 0
        top = np.argsort(-z, kind="stable")[:params.per_category]
        chosen.update(top[z[top] > 0].tolist())
    return np.array(sorted(chosen), dtype=np.int64)


def _fit(x: np.ndarray, y: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Weights of a logistic model by accelerated gradient steps; the last column of ``x`` is ones, for the intercept."""
    rate = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return w
    step = 4 / (np.einsum("ij,ij->", x, x) / len(x) + params.ridge)
    ahead, speed = w.copy(), 1.0
    for _ in range(params.rounds):
        slope = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) / len(y) + params.ridge * np.append(ahead[:-1], 0)
        new = ahead - step * slope
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, w, speed = new + (speed - 1) / faster * (new - w), new, faster
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def fit_chain(x: np.ndarray, marks: np.ndarray, params: ToxicityParams) -> list[np.ndarray]:
    """One weight vector per category, over the features and the earlier categories' probabilities."""
    fold = np.arange(len(x)) % params.folds
    chain, earlier = [], np.zeros((len(x), 0))
    for c in range(marks.shape[1]):
        inputs, y = np.column_stack((x, earlier, np.ones(len(x)))), marks[:, c].astype(float)
        out = np.zeros(len(x))
        for k in range(params.folds):
            rest, own = fold != k, fold == k
            out[own] = _probability(inputs[own, :-1], _fit(inputs[rest], y[rest], params))
        chain.append(_fit(inputs, y, params))
        earlier = np.column_stack((earlier, out))
    return chain


def train_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> tuple[np.ndarray, list[np.ndarray]]:
    """(buckets, chain) from labelled rows that are not held out.

    ``labels`` marks a row as toxic or not; the language of a toxic row, which only training sees, says which category
    of insult it is. A category without examples keeps its smoothed prior.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(id_col)).select(id_col, F.col("toxic").cast("int").alias("toxic"))
    langs = [c.rsplit("_", 1)[1] for c in CATEGORIES[:-1]]
    position = F.array_position(F.array(*map(F.lit, langs)), F.col(lang_col)).cast("int")  # null and others: no category of their own
    known = docs.select(F.col(id_col).alias("lang_id"), position.alias("lang_at")).groupBy("lang_id").agg(F.min("lang_at").alias("lang_at"))
    usable = usable.join(known, F.col(id_col) == F.col("lang_id"), "left").select(id_col, "toxic", F.coalesce("lang_at", F.lit(0)).alias("lang_at"))
    examples, marks = sampled_features(labelled_sample(docs, usable, params.sample, id_col, text_col), _counts, params.bits, ["toxic", "lang_at"])
    columns = [(marks[:, 0] == 1) & (marks[:, 1] == k + 1) for k in range(len(langs))] + [marks[:, 0] == 1]
    target = np.column_stack(columns).astype(np.int64)
    buckets = select_features(examples, target, params)
    x = np.zeros((len(examples), len(buckets)))
    for i, (bucket, share) in enumerate(examples):
        at = np.searchsorted(buckets, bucket)
        hit = np.flatnonzero((at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == bucket)) if len(buckets) else []
        x[i, at[hit]] = _scaled(share[hit])
    del examples
    return buckets, fit_chain(x, target, params)


def _counts(data, offsets, bits):
    return toxicity_groups(data, offsets, bits)


def _scaled(share: np.ndarray) -> np.ndarray:
    """Shares of a document's features, on a scale where one in fifty words counts as much as every word."""
    return np.minimum(1.0, 200 * share) ** 0.5


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, list[np.ndarray]], params: ToxicityParams = DEFAULTS, text_col: str = "text",
                   prefix: str = "") -> DataFrame:
    """``docs`` with the probability of every category; null and empty texts get those of a text without features."""
    names = [prefix + c for c in CATEGORIES]
    taken = {n.lower() for n in names}
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    column = np.full(1 << params.bits, -1, dtype=np.int16)
    column[model[0]] = np.arange(len(model[0]))
    shared = docs.sparkSession.sparkContext.broadcast((column, model[1]))  # 2 ** bits small numbers whatever the data
    bits = params.bits

    def scored(batches):
        table, chain = shared.value
        width = int(table.max()) + 1
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            out = np.zeros((batch.num_rows, len(chain)))
            for a, b in runs(offsets):
                hits, total = np.zeros((b - a) * width), np.zeros(b - a)
                for values, first, end in toxicity_groups(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], bits):
                    at = table[values]
                    found = np.flatnonzero(at >= 0)
                    doc = np.searchsorted(end, found, side="right")
                    hits += np.bincount(doc * width + at[found], minlength=len(hits))
                    total += end - first
                x = _scaled(hits.reshape(b - a, width) / np.maximum(total, 1)[:, None])
                for c, w in enumerate(chain):
                    out[a:b, c] = _probability(np.column_stack((x, out[a:b, :c])), w)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, c]) for c in range(len(chain)))], [*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` double" for n in names])
    return docs.mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = DEFAULTS) -> DataFrame:
    """The documents that the chain does not call toxic, with the columns they had."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, params), params, prefix="__p_")
    return scored.where(F.col("__p_toxic") < params.threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
