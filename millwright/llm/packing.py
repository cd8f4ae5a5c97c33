"""Best-fit packing of token pieces into sequences, with certified bin counts.

Every partition packs its pieces best-fit decreasing and compares its bins with a lower bound from dual feasible
functions. Where both agree the partition is optimal and settled. Partitions with a gap give the pieces of their loosely
filled bins, and every partition those of its emptiest bin, to an exchange; the exchanged pieces are dealt to fewer
partitions and packed again. An exchange that does not lower the number of bins is undone and ends the rounds.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.bpe import MAX_KEPT_BYTES, MAX_PIECES, encoder
from millwright.session import scratch_table

PIECES = "piece int, start long, length long, ids_crc32 long"
PARTITION_PIECES = 16_384  # pieces that one task packs
SETTLED_FILL = 0.99  # bins filled so far stay as they are
MAX_ROUNDS = 4


class PieceEncoder(dict):
    """Texts to the bytes of their ids (uint32) by a tokenizer file; as a mapping, pieces to theirs, with the most recent kept.

    Where the file says nothing but byte-level pairs, a text is split here and each piece is merged by the library's model once.
    Any other file, and a text with one of the file's added tokens, goes to the library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            told = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.added = [t["content"] for t in told["added_tokens"] if not t["special"]]
        model, first = told["model"], told["pre_tokenizer"] or {}
        self.plain = (not told["normalizer"] and not told["post_processor"] and not told["truncation"] and not told["padding"] and first.get("type") == "ByteLevel"
                      and not first["add_prefix_space"] and first["use_regex"] and model["type"] == "BPE" and not model["dropout"])
        self.tokenize, self.split = self.whole.model.tokenize, regex.compile(public_tokenizers.PATTERN).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow U+0100
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > MAX_KEPT_BYTES:
            return self._whole(piece)
        if len(self) >= MAX_PIECES:
            self.clear()
        ids = self[piece] = np.array([t.id for t in self.tokenize(data.decode("latin-1").translate(self.letters))], dtype="<u4").tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain or any(t in text for t in self.added):
            return self._whole(text)
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A text to the bytes of its ids, by a rank file (.tiktoken) or a tokenizer file; special tokens in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        ranked = encoder(path, public_tokenizers.PATTERN)
        return lambda text: np.array(ranked.encode(text), dtype="<u4").tobytes()
    return PieceEncoder(path).encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows of at most ``capacity`` tokens: the ids of each whole text and ``end_id``; of a longer one the first piece has the remainder.

    A null text is an empty one, and its piece holds the end id alone. ``with_ids`` adds the ids themselves.
    """
    rows = docs.select(id_col, text_col)

    def run(batches):
        encode, end = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column(text_col).to_pylist()):
                    ids = np.frombuffer(encode(text or "") + end, dtype="<u4")
                    edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        doc.append(i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [part.column(id_col).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {PIECES}" + ", ids array<int>" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[n]`` pieces have length n.

    The largest of the sums of three families of dual feasible functions: the length itself; the one that drops lengths
    under e and counts those over capacity - e as whole, for every e; and floor((k + 1) x) / k for k up to 20.
    """
    lengths = np.arange(capacity + 1)
    best = -(-int((counts * lengths).sum()) // capacity)
    number, volume = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - e + 1])
        best = max(best, large - (-int(volume[capacity - e + 1] - volume[e]) // capacity))
    for k in range(1, 21):
        even = (k + 1) * lengths % capacity == 0
        exact, steps = int((counts * lengths)[even].sum()), int((counts * ((k + 1) * lengths // capacity))[~even].sum())
        best = max(best, -(-(exact * k + steps * capacity) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, free room of each bin): longest first, each into the fullest bin that takes it."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit f is set if a bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            at, room = len(free), capacity
            free.append(0)
        place[i], offset[i] = at, capacity - room
        free[at] = room - size
        if free[at]:
            with_room[free[at]].append(at)
            rooms |= 1 << free[at]
    return place, offset, np.array(free, dtype=np.int64)


def _packed(pieces: DataFrame, parts: int, capacity: int, round_: int) -> DataFrame:
    """One round: every partition's bins, and which pieces go to the exchange."""

    def run(batches):
        batches = list(batches)  # at most about PARTITION_PIECES rows: the exchange before deals them evenly
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        lengths = table.column("length").to_numpy()
        place, offset, free = best_fit_decreasing(lengths, capacity)
        settled = len(free) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = np.zeros(len(free), bool) if settled else free > (1 - SETTLED_FILL) * capacity
        loose[np.argmax(free)] |= free.max() > 0
        base = (round_ << 52) + (TaskContext.get().partitionId() << 24)
        yield from table.append_column("sequence_id", pa.array(base + place)).append_column("offset", pa.array(offset)).append_column(
            "loose", pa.array(loose[place])).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.repartition(parts).mapInArrow(run, f"{schema}, sequence_id long, offset long, loose boolean")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length`` up to ``capacity``, from a written table) with ``sequence_id`` and ``offset``.

    Sequences are filled without gaps from offset 0. Only histograms of lengths and counts reach the driver.
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row.length] = row["count"]
    total, bound = int(histogram.sum()), lower_bound(histogram, capacity)
    parts = max(1, math.ceil(total / PARTITION_PIECES))
    placed = scratch_table(_packed(pieces, parts, capacity, 0), "packed")
    done, bins = [], placed.select("sequence_id").distinct().count()
    for round_ in range(1, MAX_ROUNDS):
        if parts == 1 or bins == bound:
            break
        loose = placed.where("loose").drop("loose")
        before, moving = loose.agg(F.countDistinct("sequence_id"), F.count("*")).first()
        if before < 2:
            break
        parts = min(parts - 1, max(1, math.ceil(moving / PARTITION_PIECES)))
        again = scratch_table(_packed(loose.drop("sequence_id", "offset"), parts, capacity, round_), "packed")
        after = again.select("sequence_id").distinct().count()
        if after >= before:
            break
        done.append(placed.where("not loose").drop("loose"))
        placed, bins = again, bins - before + after
    out = placed.drop("loose")
    for kept in done:
        out = out.unionByName(kept)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` tokens: identifier, piece, start, length, checksum, sequence, offset.

    Every row of ``docs`` is packed, repeated rows too; null and empty texts are a piece with the end id alone. Only
    the identifier and the text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    return pack_pieces(scratch_table(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
