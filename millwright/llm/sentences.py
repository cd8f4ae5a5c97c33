"""Substring dedup over sliding spans of sentences.

A span is a run of several consecutive sentences with enough words: the shortest such run that begins, and the shortest
that ends, at each sentence. All spans are hashed and counted over the corpus; a sentence goes if a span that covers it
also stands somewhere before, by document and place. So the first copy of a passage stays whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.arrays import Prefixes, runs, text_bytes, words
from millwright.llm.repeats import joined_spans, outside, with_spans
from millwright.session import scratch_table

BROADCAST_ROWS = 1_000_000  # hashes of repeated spans, 8 bytes each; beyond this the join shuffles


@dataclass(frozen=True)
class SpanParams:
    sentences: int = 2  # in a span, at least
    words: int = 20  # in a span, at least


DEFAULTS = SpanParams()


def sentence_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, document) of every sentence that has a word, white space after it included.

    A sentence ends with a line, or with a full stop, exclamation or question mark before white space or the text's end.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), dtype=bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    stop = (data == 46) | (data == 33) | (data == 63)
    close = (stop & (np.append(space[1:], True) | last)) | (data == 10)
    # a sentence begins at the first byte after white space that follows a closing byte, or with the text
    closed = np.maximum.accumulate(np.where(close, np.arange(len(data)), -1))
    spoken = np.maximum.accumulate(np.where(~space & ~close, np.arange(len(data)), -1))
    begin = np.zeros(len(data), dtype=bool)
    begin[1:] = ~space[1:] & (closed[:-1] >= 0) & (closed[:-1] > spoken[:-1])
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = np.flatnonzero(begin)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, np.minimum(np.append(start[1:], len(data)), offsets[doc + 1]), doc


def spans_of(data: np.ndarray, offsets: np.ndarray, params: SpanParams) -> tuple[np.ndarray, ...]:
    """(document, begin, end, two hashes) of every span. White space around sentences does not count."""
    start, end, doc = sentence_edges(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(start):
        return (none,) * 5
    first_word, word_end, _ = words(data, offsets)
    if not len(first_word):
        return (none,) * 5
    upto = np.searchsorted(first_word, np.append(start, len(data)))  # words before each sentence
    has = upto[1:] > upto[:-1]
    start, end, doc = start[has], end[has], doc[has]
    low, high = upto[:-1][has], upto[1:][has]
    name = Prefixes(data).of(first_word, word_end)
    in_words = Prefixes(name, 0), Prefixes(name, 1)
    sentence = np.arange(len(start))
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    # forward: the first sentence by whose end enough words have come; backward: the last by whose begin enough are left
    until = np.maximum(np.searchsorted(high, low + params.words), sentence + params.sentences - 1)
    since = np.minimum(np.searchsorted(low, high - params.words, side="right") - 1, sentence - params.sentences + 1)
    ahead, back = until < bounds[doc + 1], since >= bounds[doc]
    pair = np.concatenate((sentence[ahead] * len(start) + until[ahead], since[back] * len(start) + sentence[back]))
    pair = np.unique(pair)  # a run that is both counts once
    a, b = pair // len(start), pair % len(start)
    return doc[a], start[a], end[b], *(h.of(low[a], high[b]).view(np.int64) for h in in_words)


def _spans(docs: DataFrame, id_col: str, text_col: str, params: SpanParams) -> DataFrame:
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
                        F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in runs(offsets):
                doc, begin, end, h1, h2 = spans_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], params)
                rows, base = pa.array(doc + a), offsets[a + doc] - offsets[a]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("id", "k1", "k2")), pa.array(begin - base), pa.array(end - base), pa.array(h1), pa.array(h2)],
                                                 ["id", "k1", "k2", "begin", "end", "h1", "h2"])

    return keyed.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, k1 long, k2 long, begin long, end long, h1 long, h2 long")


def repeated_sentence_spans(docs: DataFrame, params: SpanParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, begin, end) in bytes of the spans that stand at an earlier place too."""
    spans = _spans(docs, id_col, text_col, params)
    often = scratch_table(spans.groupBy("h1").count().where("count > 1").select("h1"), "often")
    few = often.count() <= BROADCAST_ROWS
    shared = scratch_table(spans.join(F.broadcast(often) if few else often, "h1", "left_semi"), "shared-spans")
    place = F.struct("id", "k2", "begin")
    first = shared.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    return shared.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("k1", "k2", "begin", "end").distinct()


def without_repeated_sentences(docs: DataFrame, params: SpanParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_bytes, n_removed, n_spans) of every row: the text that is left, its former bytes, and what was cut out.

    Null and empty texts have no sentences and stay as they are. Rows alike in identifier and text are one document: none of them
    is a copy of the other. Only the identifier and the text are read, so other columns cannot clash.
    """
    docs = docs.select(id_col, text_col)
    found = with_spans(docs, repeated_sentence_spans(docs, params, id_col, text_col), id_col, text_col).select(
        F.col(f"row.{id_col}").alias("id"), F.col(f"row.{text_col}").alias("text"), "begin", "end")

    def run(batches):
        for batch in batches:
            out = []
            for text, begin, end in zip(*(batch.column(c) for c in ("text", "begin", "end"))):
                text = text.as_py()
                data = (text or "").encode()
                spans = joined_spans(begin.as_py() or [], end.as_py() or [])
                out.append((outside(data, spans).decode() if spans else text, len(data), sum(b - a for a, b in spans), len(spans)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                             [id_col, text_col, "n_bytes", "n_removed", "n_spans"])

    return found.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{text_col}` string, n_bytes long, n_removed long, n_spans long")
