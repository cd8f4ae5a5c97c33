"""Suffix-array dedup: every byte covered by a long string that also starts anywhere else.

Sorting all suffixes of a corpus in one place does not scale, so strings are first brought together by content. Of the
short substrings within a window of ``length`` bytes the one with the smallest hash is its anchor. Windows of one document
with the same anchor are consecutive; together they are a cell, and equal windows lie in cells with equal anchors. So:

1. an anchor with one cell has no repeat, and equal cells are repeats of each other whole;
2. cells that differ under one anchor, which is where copies begin, end or were edited, go together by anchor; there
   shards of them are sorted, and their Burrows-Wheeler transforms merged by interleave refinement (``bwt``); intervals
   of rows with ``length`` bytes in common are the repeats;
3. an anchor with very many different cells (a passage in a third of all documents, with other text around each) is
   divided: windows are dealt by their place about the anchor, and by a hash of the bytes that all windows of that
   place contain. The last such step has single windows, which are only counted.

Equality of whole cells is decided by 128 bits of hash, that of windows in step 2 by their bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.arrays import CHUNK_BYTES, Prefixes, runs, text_bytes
from millwright.llm.bwt import repeated_starts
from millwright.session import scratch_table

GRAM_SHARE = 0.32  # of the length: bytes of the substrings that anchors are chosen from
GROUP_CELLS = 256  # different cells under one key that go to one task together
TASK_BYTES = 4 << 20
MERGE_BYTES = 1 << 18  # cells whose transforms are merged at a time
WIDTHS = (32, 4, 1)  # window starts dealt together, step by step, under crowded anchors
PLACE_BITS = 28  # of a place within a piece; the same for all pieces, as of equal hashes the last counts
SLICE_ROWS = 1024  # cells that are Python objects at a time
CELL = "k1 long, k2 long, place long, windows int, back int, a1 long, a2 long, s1 long, s2 long"


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text) of every row; rows that are alike in both share a key, which is right for all their answers."""
    return docs.select(F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"), F.col(text_col).alias("text"))


def _smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(ahead[:count], np.minimum.accumulate(block, axis=1).ravel()[width - 1:width - 1 + count])


def cells_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor less first window, two anchor hashes, two cell hashes) of every cell."""
    gram = max(1, int(length * GRAM_SHARE))
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 8
    hashes = Prefixes(data, 0), Prefixes(data, 1)
    at = np.arange(len(data) - gram + 1)
    name = hashes[0].of(at, at + gram)
    # the smallest hash, of equal ones the last: the place counts down in the low bits
    places = np.uint64((1 << PLACE_BITS) - 1)
    key = (name & ~places) | (places - at.astype(np.uint64))
    anchor = (places - (_smallest_in_windows(key, width) & places)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[doc + 1]
    start, anchor, doc = start[inside], anchor[inside], doc[inside]
    if not len(start):
        return (none,) * 8
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(start)))
    start, anchor, doc = start[first], anchor[first], doc[first]
    end = start + count - 1 + length
    return (doc, start, count, anchor - start, name[anchor].view(np.int64), hashes[1].of(anchor, anchor + gram).view(np.int64),
            hashes[0].of(start, end).view(np.int64), hashes[1].of(start, end).view(np.int64))


def _pieces(offsets: np.ndarray, length: int, size: int = CHUNK_BYTES):
    """(first document, end, first byte, end) of what is worked on at a time.

    A longer document is taken in pieces that share ``length`` - 1 bytes, so every window is in one piece. A cell that is
    cut there is two cells of one anchor, which are compared like any two.
    """
    for a, b in runs(offsets, size):
        first, last = int(offsets[a]), int(offsets[b])
        step = last - first if b - a > 1 else size
        for begin in range(first, max(last - length + 1, first + 1), max(step, 1)):
            yield a, b, begin, min(begin + step + length - 1, last)


def _cells(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            for a, b, begin, end in _pieces(offsets, length):
                bounds = (offsets[a:b + 1] - begin).clip(0, end - begin)
                doc, start, count, back, a1, a2, s1, s2 = cells_of(data[begin:end], bounds, length)
                place = start + begin - offsets[a + doc]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0][a + doc], keys[1][a + doc], place, count.astype(np.int32), back.astype(np.int32), a1, a2, s1, s2)],
                                                 ["k1", "k2", "place", "windows", "back", "a1", "a2", "s1", "s2"])

    return texts.mapInArrow(run, CELL)


def _spans(cells: DataFrame, length: int) -> DataFrame:
    """(k1, k2, begin, end) of the bytes that all windows of a cell cover."""
    return cells.select("k1", "k2", F.col("place").alias("begin"), (F.col("place") + F.col("windows") - 1 + length).alias("end"))


def _read_cells(cells: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``cells`` with their bytes, as ``body``."""
    named = [c for c in cells.columns if c not in ("k1", "k2")]
    by_row = cells.groupBy("k1", "k2").agg(F.collect_list(F.struct(*named)).alias("cells"))  # as many as one text has
    joined = texts.join(by_row, ["k1", "k2"])
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                found = batch.column("cells")[i].values
                fields = {n: found.field(n) for n in named}
                for at in range(0, len(found), SLICE_ROWS):
                    part = {n: f.slice(at, SLICE_ROWS) for n, f in fields.items()}
                    bodies = [text[p:p + w - 1 + length] for p, w in zip(part["place"].to_pylist(), part["windows"].to_pylist())]
                    k = [pa.array([batch.column(c)[i].as_py()] * len(bodies), pa.int64()) for c in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*k, *part.values(), pa.array(bodies, pa.binary())], ["k1", "k2", *named, "body"])

    schema = ", ".join(["k1 long", "k2 long", *(f"{n} {kinds[n]}" for n in named), "body binary"])
    return joined.mapInArrow(run, schema).dropDuplicates(["a1", "a2", "s1", "s2"])


def _rows(batch: pa.RecordBatch):
    """The rows of a batch, of which few are Python objects at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield from batch.slice(at, SLICE_ROWS).to_pylist()


def _divided(cells: DataFrame, width: int, length: int) -> DataFrame:
    """Cells of at most ``width`` windows, each keyed by its place about the anchor and the bytes that all windows there share."""

    def halves(data: bytes) -> tuple[int, int]:
        digest = hashlib.blake2b(data, digest_size=16).digest()
        return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for r in _rows(batch):
                low, body = -r["back"], r["body"]
                own = b"%d/%d/" % (r["a1"], r["a2"])
                for slot in range(low // width, (low + r["windows"] - 1) // width + 1):
                    a, b = slot * width, slot * width + width - 1
                    first, last = max(a, low), min(b, low + r["windows"] - 1)
                    piece = body[first - low:last - low + length]
                    a1, a2 = halves(own + b"%d:" % slot + body[b - low:a - low + length])
                    s1, s2 = halves(b"%d:" % first + piece)
                    out.append({"k1": r["k1"], "k2": r["k2"], "place": r["place"] + first - low, "windows": last - first + 1, "back": -first, "a1": a1, "a2": a2, "s1": s1, "s2": s2,
                                "weight": r["weight"], "body": piece})
                if len(out) >= SLICE_ROWS:
                    yield from pa.Table.from_pylist(out, schema=_ARROW).to_batches()
                    out = []
            if out:
                yield from pa.Table.from_pylist(out, schema=_ARROW).to_batches()

    return cells.select(*_ARROW.names).mapInArrow(run, f"{CELL}, weight long, body binary")


_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), ("windows", pa.int32()), ("back", pa.int32()), ("a1", pa.int64()), ("a2", pa.int64()),
                    ("s1", pa.int64()), ("s2", pa.int64()), ("weight", pa.int64()), ("body", pa.binary())])


def _merged(cells: DataFrame, length: int) -> DataFrame:
    """Spans of repeats among the cells of each anchor, by merged transforms; all cells of an anchor are in one partition, side by side."""

    def flush(rows: list[dict]):
        out = []
        for row, starts in zip(rows, repeated_starts([r["body"] for r in rows], [r["weight"] for r in rows], length)):
            if row["weight"] == 1 and len(starts):  # the windows of equal cells are repeats already
                cut = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()):
                    out.append((row["k1"], row["k2"], row["place"] + a, row["place"] + b + length))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], ["k1", "k2", "begin", "end"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in _rows(batch):
                key = (row["a1"], row["a2"])
                if size >= MERGE_BYTES and key != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["body"]), key
        if held:
            yield flush(held)

    return cells.select("k1", "k2", "place", "weight", "a1", "a2", "body").mapInArrow(run, "k1 long, k2 long, begin long, end long")


def repeated_spans(texts: DataFrame, length: int = 400) -> DataFrame:
    """(k1, k2, begin, end) in bytes, overlapping, of all substrings of ``length`` bytes that start at two places or more.

    ``texts``: k1, k2, text, one row for each document; a row that is repeated repeats all of its text.
    """
    key, cell = ["a1", "a2"], ["a1", "a2", "s1", "s2"]
    cells = scratch_table(_cells(texts, length), "cells")
    differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    anchors = cells.groupBy(*key).agg(F.count("*").alias("n"), differ.alias("differ")).where("n > 1").drop("n")
    shared = scratch_table(cells.join(anchors, key), "shared-cells")
    spans = [_spans(shared.where("not differ"), length)]
    mixed = shared.where("differ").drop("differ")
    kinds = scratch_table(mixed.groupBy(*cell).agg(F.count("*").alias("weight"), F.min_by(F.struct("k1", "k2", "place", "windows", "back"), "k1").alias("one")).select(
        "one.*", *cell, "weight"), "cell-kinds")
    spans.append(_spans(mixed.join(kinds.where("weight > 1").select(*cell), cell, "left_semi"), length))
    groups = scratch_table(_read_cells(kinds, texts, length), "cell-texts")
    for width in (*WIDTHS, 0):
        crowd = groups.groupBy(*key).agg(F.count("*").alias("kinds"))
        known = groups.join(crowd.where("kinds > 1"), key)
        spans.append(scratch_table(_in_tasks(known.where(F.col("kinds") <= GROUP_CELLS), length), "merged-spans"))
        crowded = known.where(F.col("kinds") > GROUP_CELLS)
        if not width or crowded.limit(1).count() == 0:
            break
        parts = scratch_table(_divided(crowded, min(width, length), length), "cell-parts")
        total = parts.groupBy(*cell).agg(F.sum("weight").alias("total"), F.min_by(F.struct("k1", "k2", "place", "windows", "back", "body"), "k1").alias("one"))
        total = scratch_table(total.select("one.*", *cell, F.col("total").alias("weight")), "cell-texts")
        again = parts.where("weight = 1").join(total.where("weight > 1").select(*cell), cell, "left_semi")
        spans.append(_spans(again, length))
        groups = total
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _in_tasks(cells: DataFrame, length: int) -> DataFrame:
    size = cells.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return _merged(cells.repartition(max(1, math.ceil(size / TASK_BYTES)), "a1", "a2").sortWithinPartitions("a1", "a2"), length)


def joined_spans(begin: list[int], end: list[int]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin, end)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they hold only in part."""
    out = []
    for a, b in spans:
        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def outside(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, begin, end): each row of ``docs`` as a struct, and the begins and ends of its spans."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("k1"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"))
    # rows alike in id and text tell the same spans: each counts once, so there are as many as one text has
    listed = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("s")).select("k1", "k2", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"))
    return keyed.join(listed, ["k1", "k2"], "left").select("row", "begin", "end")


def removal_digests(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row. A null text is an empty one; repeated rows are places of their own."""
    docs = docs.select(id_col, text_col)
    found = with_spans(docs, repeated_spans(row_keys(docs, id_col, text_col), length), id_col, text_col).select(
        F.col(f"row.{id_col}").alias("id"), F.col(f"row.{text_col}").alias("text"), "begin", "end")

    def run(batches):
        for batch in batches:
            out = []
            for text, begin, end in zip(*(batch.column(c) for c in ("text", "begin", "end"))):
                data = (text.as_py() or "").encode()
                spans = joined_spans(begin.as_py() or [], end.as_py() or [])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(outside(data, spans)).hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated spans cut out of the text, in whole characters, and the character count brought up to date.

    Every copy of a repeated string goes, the first as well. A null text stays null; other columns, whatever their
    names, pass through as they are.
    """
    found = with_spans(docs, repeated_spans(row_keys(docs, id_col, text_col), length), id_col, text_col)

    def run(batches):
        for batch in batches:
            kept = []
            row = batch.column("row")
            fields = row.flatten()
            for text, begin, end in zip(fields[at], batch.column("begin"), batch.column("end")):
                text = text.as_py()
                if text is not None and begin.is_valid and len(begin):
                    data = text.encode()
                    text = outside(data, whole_characters(data, joined_spans(begin.as_py(), end.as_py()))).decode()
                kept.append(text)
            fields[at] = pa.array(kept, row.type[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"])

    at = docs.columns.index(text_col)
    cut = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}")
    columns = []
    for f in docs.schema.fields:
        column = F.col(f"row.`{f.name}`")
        if f.name == count_col:
            column = F.when(F.col(f"row.`{text_col}`").isNull(), column).otherwise(F.char_length(f"row.`{text_col}`").cast(f.dataType))
        columns.append(column.alias(f.name))
    return cut.select(*columns)
