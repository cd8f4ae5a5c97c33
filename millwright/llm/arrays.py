"""Texts of an Arrow batch as flat byte arrays, and hashes of their pieces, for the numpy parts of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17  # texts are worked on in runs of whole documents of about this size
_ODD = 0x9E3779B97F4A7C15  # any odd number; the golden ratio spreads bits well
_INVERSE = pow(_ODD, -1, 1 << 64)
_KEPT = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_SEEDED = np.random.default_rng(20240601).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, start of each text and the end of the last); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (first, end) document ranges of about ``size`` bytes; one long document is a range of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), count)
        yield first, end
        first = end


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = values ^ (values >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the odd number and of its inverse, at least n. A table as long as two runs is kept; what a longer text needs is not."""
    if len(_KEPT[0]) >= n:
        return _KEPT[0], _KEPT[1]
    made = []
    for step in (_ODD, _INVERSE):
        powers = np.full(max(n, 2 * CHUNK_BYTES), step, dtype=np.uint64)
        powers[0] = 1
        made.append(np.cumprod(powers, out=powers))
    if n <= 2 * CHUNK_BYTES:
        _KEPT[:] = made
    return made[0], made[1]


class Prefixes:
    """Hashes of any byte range of one array, from running sums: equal ranges hash alike wherever they stand."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        """``data``: bytes, or any 64-bit numbers that are hashes themselves."""
        n = len(data)
        values = _SEEDED[seed][data] if data.dtype == np.uint8 else mixed(data + np.uint64(seed)) | np.uint64(1)
        power, self._undo = _powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.multiply(values, power[:n], out=self._sums[1:])
        np.cumsum(self._sums[1:], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._undo[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes other than space and the five controls from tab to return."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    starts_here = np.zeros(len(data) + 1, dtype=bool)
    starts_here[offsets[:-1]] = True  # a document also ends the word before it
    starts_here[-1] = False
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    start = np.flatnonzero(after & (edge | starts_here))
    end = np.flatnonzero(before & (edge | np.concatenate((starts_here[:-1], [True]))))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)

