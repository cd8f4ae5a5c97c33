"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

A piece of text (one match of the splitting pattern) is read byte by byte. The transducer's state is the last token it
has emitted and the bytes it still holds; a token leaves as soon as every way to go on agrees on it, so the held bytes
stay shorter than a few tokens. A sequence of tokens is what merging yields exactly if each neighbouring pair is what
merging its bytes yields, so a transition is found from the held bytes alone. Transitions are found when they are first
needed and kept. States are forgotten and found anew beyond a limit, so memory stays bounded whatever is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRANSITIONS = 500_000
MAX_PIECES = 250_000  # outputs of whole pieces kept
MAX_KEPT_BYTES = 64  # longer pieces are never kept
CHUNK = 8_192  # ids decoded at a time


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file; the file is at the same place on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Pieces of bytes to token ids. One object per process; not shared between threads."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.beginnings = {token[:n] for token in ranks for n in range(1, len(token))}
        self._pairs: dict[int, bool] = {}
        self._joined: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self._states = {(-1, b""): 0}
        self._facts: list[tuple[int, bytes]] = [(-1, b"")]
        self._known: list[tuple[tuple, tuple, tuple]] = [((-1,), (-1,), (0,))]
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._rest: dict[int, tuple[int, ...]] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging last joined into ``token``; none for a byte, or if merging never makes it."""
        if token not in self._joined:
            data, found = self.tokens[token], None
            for n in range(1, len(data)):
                left, right = self.ranks.get(data[:n]), self.ranks.get(data[n:])
                if left is not None and right is not None and self._reached(left) and self._reached(right) and self._apart(left, right, token):
                    found = (left, right)
                    break
            self._joined[token] = found
        return self._joined[token]

    def _reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self._parts(token) is not None

    def _inner(self, token: int, side: int) -> list[int]:
        """The tokens at one end (1: last, 0: first) of ``token`` while it is put together, from its byte to itself."""
        key = token << 1 | side
        edge = self._edges.get(key)
        if edge is None:
            parts = self._parts(token)
            edge = self._edges[key] = [token] if parts is None else [*self._inner(parts[side], side), token]
        return edge

    def _apart(self, left: int, right: int, until: int) -> bool:
        """True if merging both tokens' bytes joins nothing across their border before rank ``until``."""
        lefts, rights, i, j = self._inner(left, 1), self._inner(right, 0), 0, 0
        never = len(self.tokens)
        while True:
            joint = self.ranks.get(self.tokens[lefts[i]] + self.tokens[rights[j]], never)
            next_left = lefts[i + 1] if i + 1 < len(lefts) else never
            next_right = rights[j + 1] if j + 1 < len(rights) else never
            if joint < min(next_left, until) and joint <= next_right:  # of equal ranks the leftmost goes first
                return False
            if next_left == never and next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _agree(self, left: int, right: int) -> bool:
        """True if ``right`` can follow ``left`` (-1: the start of a piece)."""
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            known = self._reached(right) and (left < 0 or self._apart(left, right, len(self.tokens)))
            if len(self._pairs) > MAX_TRANSITIONS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition from ``state`` by ``byte``: the next state and the tokens that leave.

        A state knows, for the positions of its held bytes, which token ends there and where that starts, and which
        positions are open: a token may still begin there and reach beyond the held bytes.
        """
        last, held = self._facts[state]
        ending, start, open_at = self._known[state]
        held += bytes((byte,))
        found, begin = None, -1
        for p in open_at:
            token = self.ranks.get(held[p:])
            if token is not None and self._agree(ending[p], token):
                found, begin = token, p
                break
        ending, start = (*ending, found), (*start, begin)
        still = [p for p in open_at if held[p:] in self.beginnings]
        if found is not None:
            still.append(len(held))
        common = set(still)  # ends as the last position that every way to an open one passes
        while len(common) > 1:
            common.add(start[deepest := max(common)])
            common.remove(deepest)
        agreed = common.pop()
        out, p = [], agreed
        while p > 0:
            out.append(ending[p])
            p = start[p]
        if agreed:
            last, held = ending[agreed], held[agreed:]
            ending, start = ending[agreed:], (-1, *(p - agreed for p in start[agreed + 1:]))
            still = [p - agreed for p in still]
        target = self._states.setdefault((last, held), len(self._facts))
        if target == len(self._facts):
            self._facts.append((last, held))
            self._known.append((ending, start, tuple(still)))
        made = self._next[state << 8 | byte] = (target, tuple(out[::-1]))
        return made

    def _end(self, state: int) -> tuple[int, ...]:
        ending, start, _ = self._known[state]
        out, p = [], len(ending) - 1
        while p > 0:
            out.append(ending[p])
            p = start[p]
        made = self._rest[state] = tuple(out[::-1])
        return made

    def encode(self, piece: bytes) -> tuple[int, ...]:
        token = self.ranks.get(piece)
        if token is not None:
            return (token,)
        if len(self._next) > MAX_TRANSITIONS:
            self._forget()
        state, out, known = 0, [], self._next
        for byte in piece:
            step = known.get(state << 8 | byte)
            if step is None:
                step = self._make(state, byte)
            state, emitted = step
            if emitted:
                out.extend(emitted)
        rest = self._rest.get(state)
        out.extend(self._end(state) if rest is None else rest)
        return tuple(out)


class Encoder(dict):
    """Texts to ids; as a mapping, pieces to their ids, with the most recent pieces kept."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.transducer = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        ids = self.transducer.encode(data)
        if len(data) <= MAX_KEPT_BYTES:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _utf8_states() -> list[list[int]]:
    """Next state by state and byte: 0 between characters, -1 not UTF-8, else a character is open."""
    table = [[-1] * 256 for _ in range(8)]

    def put(state: int, low: int, high: int, target: int) -> None:
        table[state][low:high + 1] = [target] * (high + 1 - low)

    # fixed values: the well-formed byte sequences of the Unicode standard
    put(0, 0x00, 0x7F, 0)
    put(0, 0xC2, 0xDF, 1)
    put(0, 0xE0, 0xE0, 4)
    put(0, 0xE1, 0xEF, 2)
    put(0, 0xED, 0xED, 5)
    put(0, 0xF0, 0xF0, 6)
    put(0, 0xF1, 0xF3, 3)
    put(0, 0xF4, 0xF4, 7)
    put(1, 0x80, 0xBF, 0)
    put(2, 0x80, 0xBF, 1)
    put(3, 0x80, 0xBF, 2)
    put(4, 0xA0, 0xBF, 1)
    put(5, 0x80, 0x9F, 1)
    put(6, 0x90, 0xBF, 2)
    put(7, 0x80, 0x8F, 2)
    return table


_UTF8 = _utf8_states()


class StreamingDecoder:
    """Ids to text, chunk by chunk; a character split between chunks waits for its last byte."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.open = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.open + b"".join(map(self.tokens.__getitem__, ids))
        keep = 0
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] >= 0xC0:  # a first byte: is its character still open, and sound so far?
                state = 0
                for byte in data[-back:]:
                    state = _UTF8[state][byte]
                    if state <= 0:
                        break
                keep = back if state > 0 else 0
                break
        self.open = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decoded(tokens: dict[int, bytes], ids: list[int], chunk: int = CHUNK) -> Iterator[str]:
    decoder = StreamingDecoder(tokens)
    for at in range(0, len(ids), chunk):
        yield decoder.feed(ids[at:at + chunk])
    yield decoder.finish()


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text; null and empty texts have none. An input column named so is replaced."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != ids.lower()))

    def run(batches):
        encode = encoder(path, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = pa.array([encode(t or "") for t in part.column(text_col).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, ids])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{ids}` array<int>")


def decode_documents(rows: DataFrame, path: str, ids_col: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids; bytes that are not UTF-8 become replacement characters. Null ids are none."""
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() != text.lower()))

    def run(batches):
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = pa.array(["".join(decoded(tokens, i or [])) for i in part.column(ids_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, text])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{text}` string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of its ids, and checksums of the ids and of what they decode to, without the ids leaving the task."""

    def run(batches):
        coder = encoder(path, pattern)
        names, tokens = {i: str(i) for i in coder.transducer.tokens}, coder.transducer.tokens
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(text_col):
                ids = coder.encode(text.as_py() or "")
                listed, restored = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), CHUNK):
                    listed.update(("," * (at > 0) + ",".join(map(names.__getitem__, ids[at:at + CHUNK]))).encode())
                for part in decoded(tokens, ids):
                    restored.update(part.encode())
                out.append((len(ids), listed.hexdigest(), restored.hexdigest()))
            count, listed_as, restored_as = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(count, pa.int64()), pa.array(listed_as, pa.string()), pa.array(restored_as, pa.string())],
                                             [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
