"""Burrows-Wheeler transforms of small collections of byte strings, merged by iterative interleave refinement.

Strings are read in symbols of ``step`` bytes, one sequence for each phase, so a suffix at any byte is a row and one
step of refinement compares ``step`` bytes. A shard is sorted once. Merging starts from the shards one after another and
repeats: put the rows of all shards in the present order, take each row's preceding symbol from its shard's transform,
and let these symbols, kept stable, give the next order. After h rounds rows stand in the order of their first h symbols,
whichever shard they come from, without comparing a suffix again. A border between two rows that shows in round h for
the first time has a common prefix of h - 1 symbols.
"""

from __future__ import annotations

import numpy as np

from millwright.llm.arrays import Prefixes

SHARD_BYTES = 1 << 17
MOST_BYTES = 50  # of a symbol


def symbol_bytes(length: int) -> int:
    """The largest symbol of at most ``MOST_BYTES`` that divides ``length``."""
    return max(d for d in range(1, MOST_BYTES + 1) if length % d == 0)


def _alphabet(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """A dense number for the ``step`` bytes from each position, equal exactly where all bytes are.

    Numbers come from hashes, and every position is then compared, byte by byte, with the first of its number; where
    any differs, the numbers are made from the bytes themselves.
    """
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    _, first, ranks = np.unique(Prefixes(data).of(at, at + step), return_index=True, return_inverse=True)
    model = at[first][ranks]
    if all(np.array_equal(data[at + i], data[model + i]) for i in range(step)):
        return ranks
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, step)[at])
    return np.unique(rows.view(f"V{step}").ravel(), return_inverse=True)[1]


def _stable(ranks: np.ndarray) -> np.ndarray:
    """Stable order of non-negative ranks below 2 ** 32, by halves of 16 bits, which numpy sorts by radix."""
    low = np.argsort((ranks & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ranks) and ranks.max() > 0xFFFF:
        return low[np.argsort((ranks >> 16).astype(np.uint16)[low], kind="stable")]
    return low


class Shard:
    """Some of the strings: rows in the order of their first ``depth`` symbols or more, and the symbol before each."""

    def __init__(self, symbol: np.ndarray, follows: np.ndarray, before: np.ndarray, depth: int):
        """By row: its symbol (-1: fewer bytes are left), the row one symbol on (its own without one), the symbol one back (-1: none)."""
        last = symbol < 0
        self.ends = int(last.sum())
        rank = symbol + self.ends
        rank[last] = np.arange(self.ends)  # an end differs from every other row
        known, jump = 1, follows
        while known < depth:
            _, rank = np.unique(rank * (len(rank) + int(rank.max()) + 1) + rank[jump], return_inverse=True)
            known, jump = known * 2, jump[jump]
            if len(rank) == int(rank.max()) + 1:
                break
        self.rows = _stable(rank)
        self.transform = before[self.rows]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each merged row, its row there, symbols in common with the merged row before, at most ``depth``)."""
    ends = np.concatenate([np.full(s.ends, i, dtype=np.int32) for i, s in enumerate(shards)])
    rest = np.concatenate([np.full(len(s.rows) - s.ends, i, dtype=np.int32) for i, s in enumerate(shards)])
    interleave, first = np.concatenate((ends, rest)), len(ends)
    block = np.zeros(len(interleave), dtype=np.int64)  # of their first 0 symbols all rows are alike
    common = np.full(len(interleave), depth, dtype=np.int32)
    common[:first + 1] = 0
    before = np.empty(len(interleave), dtype=np.int64)
    for h in range(1, depth + 1):
        for i, shard in enumerate(shards):
            before[interleave == i] = shard.transform
        has = np.flatnonzero(before >= 0)
        order = has[_stable(before[has])]
        symbol, held = before[order], block[order]
        border = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (held[1:] != held[:-1])))[:len(order)]
        interleave = np.concatenate((ends, interleave[order]))
        new = first + np.flatnonzero(border)
        fresh = new[common[new] == depth]
        common[fresh] = h - 1
        block = np.concatenate((np.arange(first), first + np.cumsum(border) - 1)).astype(np.int64)
        if not len(fresh) and h > 1:
            break  # no block split, so none will
    row = np.empty(len(interleave), dtype=np.int64)
    for i, shard in enumerate(shards):
        row[interleave == i] = shard.rows
    return interleave, row, common


def repeated_starts(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each string the starts of its substrings of ``length`` bytes that stand at two places or more.

    A string of weight w counts as standing there w times. Places in different strings are different places.
    """
    step = symbol_bytes(length)
    depth = length // step
    groups, size = [[]], 0
    for i, s in enumerate(strings):
        if size + len(s) > SHARD_BYTES and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(s)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))  # a row for each byte and one for the end
    data = np.zeros(int(begin[-1]) + step, dtype=np.uint8)
    for i, s in enumerate(strings):
        data[begin[i]:begin[i] + len(s)] = np.frombuffer(s, dtype=np.uint8)
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    place = np.arange(begin[-1]) - begin[owner]
    symbol = np.full(len(owner), -1, dtype=np.int64)
    full = np.flatnonzero(place + step <= lengths[owner])
    symbol[full] = _alphabet(data, full, step)
    before = np.full(len(owner), -1, dtype=np.int64)
    inner = np.flatnonzero(place >= step)
    before[inner] = symbol[inner - step]
    shards, bases = [], []
    for group in groups:
        a, b = int(begin[group[0]]), int(begin[group[-1] + 1])
        follows = np.arange(b - a)
        follows[symbol[a:b] >= 0] += step
        shards.append(Shard(symbol[a:b].copy(), follows, before[a:b], depth))
        bases.append(a)
    interleave, row, common = merge(shards, depth)
    row += np.array(bases, dtype=np.int64)[interleave]
    block = np.cumsum(common < depth) - 1  # rows of one repeated interval share at least `depth` symbols
    weight = np.bincount(block, weights=np.asarray(weights, dtype=float)[owner[row]])
    found = np.sort(row[weight[block] >= 2])
    found = found[place[found] + length <= lengths[owner[found]]]
    cuts = np.searchsorted(found, begin)
    return [found[cuts[i]:cuts[i + 1]] - begin[i] for i in range(len(strings))]
