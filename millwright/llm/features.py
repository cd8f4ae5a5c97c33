"""Hashed word and character n-gram features of whole texts, computed for a run of documents at a time.

A feature is a bucket number. Words come from runs of bytes other than white space, as they are and in lower case;
n-grams are windows of UTF-8 bytes of a text, or the first bytes of a word. Nothing but the text goes in.
"""

from __future__ import annotations

import numpy as np

from millwright.llm.arrays import Prefixes, lowered, mixed, words

WINDOWS = (3, 5)  # bytes of the character n-grams
HEADS = (4, 5, 6)  # bytes of the word beginnings


def _packed(data: np.ndarray, n: int) -> np.ndarray:
    """Every window of n <= 8 bytes as one number."""
    out = data[:len(data) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out |= data[i:len(data) - n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _buckets(values: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mixed(values + np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int32)


def quality_groups(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Yields (bucket of each feature, first feature of each document, end of it): words, repetitions, n-grams."""
    start, end, doc = words(data, offsets)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    names = Prefixes(data).of(start, end)
    yield _buckets(names, 1, bits), bounds[:-1], bounds[1:]
    if len(names) > 1:  # of two neighbouring words: is it the same one again?
        ends = np.maximum(bounds[1:] - 1, bounds[:-1]).clip(max=len(names) - 1)
        yield _buckets((names[1:] == names[:-1]).astype(np.uint64), 2, bits), bounds[:-1].clip(max=len(names) - 1), ends
    for n in WINDOWS:
        if len(data) >= n:
            yield _buckets(_packed(data, n), n, bits), offsets[:-1].clip(max=len(data) - n + 1), np.maximum(offsets[1:] - n + 1, offsets[:-1]).clip(max=len(data) - n + 1)


def toxicity_groups(data: np.ndarray, offsets: np.ndarray, bits: int):
    """As quality_groups, over lower-case words without punctuation around them, and the beginnings of words."""
    low = lowered(data)
    mark = ~((low < 48) | ((low > 57) & (low < 97)) | ((low > 122) & (low < 128)))
    letters = np.where(mark, low, np.uint8(32))
    start, end, doc = words(letters, offsets)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    hashes = Prefixes(letters)
    yield _buckets(hashes.of(start, end), 11, bits), bounds[:-1], bounds[1:]
    for n in HEADS:
        long = np.flatnonzero(end - start > n)
        at = np.searchsorted(long, bounds)
        yield _buckets(hashes.of(start[long], start[long] + n), 11 + n, bits), at[:-1], at[1:]


def counted(groups, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, times) of every distinct feature, sorted, and the number of features of each document."""
    docs, buckets, total = [], [], np.zeros(documents, np.int64)
    for values, first, end in groups:
        total += end - first
        docs.append(np.repeat(np.arange(documents), end - first))
        buckets.append(values[first[0]:end[-1]] if (first[1:] == end[:-1]).all() else np.concatenate([values[a:b] for a, b in zip(first, end)]))
    key = np.concatenate(docs).astype(np.int64) << 32 | np.concatenate(buckets)
    key, times = np.unique(key, return_counts=True)
    return key >> 32, (key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), total


def summed(groups, table: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sum of ``table`` over its features (one column per table column), and their number."""
    out, total = np.zeros((documents, table.shape[1])), np.zeros(documents, np.int64)
    for values, first, end in groups:
        total += end - first
        for c in range(table.shape[1]):
            running = np.concatenate(([0.0], np.cumsum(table[values, c], dtype=np.float64)))
            out[:, c] += running[end] - running[first]
    return out, total
