"""Each operator against a plain version, and its edge cases: nulls, empty texts and tables, ties, repeated rows, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millwright.llm import bpe, bwt, minhash, neighbours, packing, quality, repeats, sentences, sharding, topk, toxicity

from . import plain

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id))]


# 1 sharding

def test_shards_are_near_equal_and_numbered(spark):
    rng = random.Random(3)
    rows = [(i, "x" * 400 if i % 3 == 0 else "y%d" % i * rng.randrange(0, 40), "clash", "clash") for i in range(4000)] + [(None, None, None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, leaf string")  # one text in a third of the rows, one row 300 times
    out = sharding.shard_documents(docs, 8, 0.02).collect()
    assert len(out) == len(rows) and "leaf" in out[0].asDict()
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in out)
    filled = [[r for r in out if r.shard == s] for s in range(8)]
    assert all(sorted(r.slot for r in f) == list(range(len(f))) for f in filled)
    sizes = [sum(r["size"] for r in f) for f in filled]
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8 + 2 * 401
    shards_of = {}
    for r in out:
        shards_of.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in shards_of.items() if t != "x" * 400) == 0  # only the large group is cut


def test_shards_of_an_empty_table(empty):
    assert sharding.shard_documents(empty).count() == 0


# 2 exact top-k and 3 approximate neighbours

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=12), 2)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, [0.0] * 12), (None, rows[0][1]), (2005, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(4), rows


def ranked(rows, asked, k, scale):
    use = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    if scale:
        use = [(i, np.floor(256 * v).astype(np.int64)) for i, v in use]
    else:
        use = [(i, v) for i, v in use if np.abs(v).max() > 0]
    out = {}
    for q, v in use:
        if asked(q):
            scored = sorted(((-(w @ v if scale else np.einsum("i,i->", w, v)), i) for i, w in use if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_exact_topk(vectors):
    df, rows = vectors
    got = grouped(topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5))
    want = {q: v for q, v in ranked(rows, lambda i: i % 50 == 0, 5, True).items() if v}
    assert got == want


def test_exact_topk_of_large_components(spark):
    rows = [(0, [2.0 ** 22, 3.0]), (1, [2.0 ** 21 + 1, -1.0]), (2, [2.0 ** 21 + 1, 1.0]), (3, [-(2.0 ** 22), 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert grouped(topk.exact_topk(df, df.where("vec_id = 0"), 2)) == ranked(rows, lambda i: i == 0, 2, True)


def test_blocks_never_come_to_the_driver(spark):
    """However small a side is guessed to be, its repeated blocks are not broadcast."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    for found in (topk.exact_topk(df, df.where("vec_id % 20 = 0"), 2), neighbours.nearest(df, df.where("vec_id % 20 = 0"), 2)):
        assert found.count() == 6
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_exact_at_factor_one(vectors):
    df, rows = vectors
    got = grouped(neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, 1.0))
    want = {q: v for q, v in ranked(rows, lambda i: i % 20 == 0, 20, False).items() if v}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_neighbours_recall(vectors):
    df, rows = vectors
    got = grouped(neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20))
    want = ranked(rows, lambda i: i % 20 == 0, 20, False)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in v}) / len(v) for q, v in want.items() if v]
    assert sum(hits) / len(hits) >= 0.9


def test_searches_over_empty_tables(vectors):
    df, _ = vectors
    none = df.where("vec_id < 0")
    assert topk.exact_topk(none, none, 5).count() == 0 and neighbours.nearest(none, none, 5).count() == 0
    assert topk.exact_topk(df, none, 5).count() == 0 and neighbours.nearest(none, df.where("vec_id = 3"), 5).count() == 0


def test_tree_visits_fewer_leaves_with_a_larger_factor():
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(3000, 3))
    body, asked = neighbours.build_tree(np.arange(3000), matrix), neighbours.build_queries(np.arange(5), matrix[:5])
    exact = neighbours.answer_block(body, asked, 10, 1.0)
    assert exact == neighbours.answer_block(body, asked, 10, 1e-9)  # all leaves


# 4 repeated strings

@pytest.mark.parametrize("length", [1, 7, 12, 32])
def test_merged_transforms(monkeypatch, length):
    monkeypatch.setattr(bwt, "SHARD_BYTES", 60)
    rng = random.Random(length)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 7))]
        strings += [strings[0][:40] + b"xyz" + strings[-1], strings[0]]
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        count = {}
        for s, w in zip(strings, weights):
            for i in range(len(s) - length + 1):
                count[s[i:i + length]] = count.get(s[i:i + length], 0) + w
        want = [[i for i in range(len(s) - length + 1) if count[s[i:i + length]] > 1] for s in strings]
        assert [x.tolist() for x in bwt.repeated_starts(strings, weights, length)] == want


def test_common_prefixes_of_merged_transforms():
    text = [b"abracadabra", b"abracadabba"]
    shards = []
    symbol = np.frombuffer(b"".join(t + b"\0" for t in text), dtype=np.uint8).astype(np.int64)
    ends = symbol == 0
    symbol[ends] = -1
    follows = np.where(ends, np.arange(24), np.arange(24) + 1)
    before = np.concatenate(([-1], symbol[:-1]))
    for a in (0, 12):
        shards.append(bwt.Shard(symbol[a:a + 12].copy(), follows[a:a + 12] - a, before[a:a + 12], 16))
    order, row, common = bwt.merge(shards, 16)
    suffixes = [(text[s] + b"")[r:] for s, r in zip(order, row)]
    assert suffixes[2:] == sorted(suffixes[2:])
    for a, b, n in zip(suffixes[2:], suffixes[3:], common[3:]):
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == shared


@pytest.mark.parametrize("cells", [256, 2])
def test_removal_digests(docs, corpus, monkeypatch, cells):
    monkeypatch.setattr(repeats, "GROUP_CELLS", cells)  # two: every busy anchor is divided down to single windows
    got = by_id(repeats.removal_digests(docs, 400), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.repeats([t for _, t in corpus], 400)
    assert sum(r[1] for r in got) > 0


def test_removal_of_self_overlap_and_repeated_rows(spark, empty):
    texts = ["ab" * 500, "q" * 399, "z" * 401, "é" * 300, "x%s" % ("é" * 199 + "end")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "once " * 20), (None, "w%d" % 5 * 300)], "doc_id long, text string")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert by_id(repeats.removal_digests(docs, 400), "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain.repeats([r.text for r in rows], 400)
    twice = spark.createDataFrame([(1, "".join(map(str, range(200))))] * 2, "doc_id long, text string")
    assert [r.n_removed for r in repeats.removal_digests(twice, 400).collect()] == [490, 490]
    often = spark.createDataFrame([(1, twice.first().text)] * 300, "doc_id long, text string").repartition(3)
    spans = repeats.repeated_spans(repeats.row_keys(often, "doc_id", "text"), 400)
    held = repeats.with_spans(often, spans, "doc_id", "text").select(F.size("begin").alias("n")).collect()
    assert len(held) == 300 and max(r.n for r in held) <= 490  # not three hundred times as many
    assert repeats.removal_digests(empty, 400).count() == 0


def test_long_texts_are_taken_in_pieces(spark):
    offsets = np.array([0, 5, 5, 905, 1000, 1300])
    seen = []
    for a, b, begin, end in repeats._pieces(offsets, 40, 100):
        for doc in range(a, b):
            low, high = max(begin, offsets[doc]), min(end, offsets[doc + 1])
            seen += [(doc, at) for at in range(low, high - 40 + 1)]
    assert sorted(seen) == [(d, at) for d in range(5) for at in range(offsets[d], offsets[d + 1] - 40 + 1)]  # every window once
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    size, shared = repeats.CHUNK_BYTES, letters(900)
    long = letters(size - 450) + shared + letters(size - 700) + shared + letters(2000)  # both copies stand across a border
    docs = spark.createDataFrame([(0, long), (1, letters(50) + shared[100:600]), (2, None)], "doc_id long, text string")
    got = by_id(repeats.removal_digests(docs, 400), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.repeats([r.text for r in sorted(docs.collect())], 400)
    assert got[0][1] >= 1800 and got[1][1] >= 500


def test_repeats_are_cut_in_whole_characters(spark):
    common = "é" * 10 + "".join(map(str, range(100, 300)))
    docs = spark.createDataFrame([(1, "è" + common, "a", 0), (2, "ê" + common, "b", 0), (3, None, "c", 7)], "doc_id long, text string, body string, n_chars int")
    out = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert out[1].text == "è" and out[2].text == "ê" and out[3].text is None
    assert (out[1].n_chars, out[3].n_chars, out[2].body) == (1, 7, "b")


# 5 tokens

def test_transducer_gives_the_library_ids():
    coder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(list(" aehtionsTE.é\n'0ß1漢😀‍|\t")) for _ in range(rng.randrange(60)))
        assert coder.encode(text) == library.encode_ordinary(text)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert coder.encode(long) == library.encode_ordinary(long)


def test_transducer_forgets_states_without_changing_results(monkeypatch):
    coder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = "the anointing of reredosation " * 3 + "unbelievable 漢字"
    want = coder.encode(text)
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 5)
    monkeypatch.setattr(bpe, "MAX_PIECES", 2)
    assert bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(text) == want


def test_streaming_decode_waits_for_whole_characters():
    tokens = {i: bytes((i,)) for i in range(256)}
    for data in ("aé漢😀b".encode(), b"\xe0\x80x", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"a\xc3", b"\xff\xc3\xa9", bytes(range(256))):
        for size in (1, 2, 3, 7):
            assert "".join(bpe.decoded(tokens, list(data), size)) == data.decode("utf-8", "replace")


def test_token_round_trip(docs, corpus, empty):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = [library.encode_ordinary(t or "") for _, t in corpus]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    got = by_id(bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == [(len(w), sha(",".join(map(str, w)).encode()), sha((t or "").encode())) for w, (_, t) in zip(want, corpus)]
    ids = bpe.encode_documents(docs.withColumn("ids", F.lit(1)), RANKS, public_tokenizers.PATTERN)
    assert [r[0] for r in by_id(ids, "ids")] == want
    assert [r[0] for r in by_id(bpe.decode_documents(ids, RANKS), "decoded")] == [t or "" for _, t in corpus]
    assert bpe.round_trip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# 6 near duplicates

@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("short", [32, 1])
def test_near_duplicates(docs, corpus, words, percent, short):
    component, size = plain.components([i for i, _ in corpus], [t for _, t in corpus], words, percent)
    got = by_id(minhash.near_duplicates(docs, minhash.NearParams(words, percent, short_list=short)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(i, n, component[i], component[i] == i) for (i, _), n in zip(corpus, size)]


def test_links_beyond_the_leader_are_found(spark):
    """A chain in which each set is like the next only, all in the same long lists."""
    texts = [" ".join(f"w{j}" for j in range(i * 2, i * 2 + 60)) for i in range(30)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    component, _ = plain.components([r[0] for r in rows[:30]], texts, 3, 85)
    for params in (minhash.NearParams(3, 85, short_list=1, leaders=1), minhash.NearParams(3, 85, k=16, short_list=2, leaders=2, rounds=1)):
        out = minhash.near_duplicates(df, params).collect()
        assert {r.doc_id: r.component_id for r in out if r.doc_id} == component
        assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2


def test_a_group_just_under_the_limit_is_compared_in_blocks(spark, monkeypatch):
    """All texts are like one another but below the limit, a few beyond it: no row for every two of them is written."""
    base, rows = [f"w{j}" for j in range(200)], []
    for i in range(90):
        words = list(base)
        for k in range(4):
            words[(i * 7 + k * 41) % 200] = f"own{i}/{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1] + " more") for i in range(0, 90, 30)]
    written, write = {}, minhash.scratch_table

    def counted(df, name):
        table = write(df, name)
        written.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(minhash, "scratch_table", counted)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 40, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, minhash.NearParams(3, 85, short_list=4, rounds=0)).collect()
    component, _ = plain.components([i for i, _ in rows], [t for _, t in rows], 3, 85)
    assert {r.doc_id: r.component_id for r in out} == component and 1 < len(set(component.values()))
    assert max(n for name in ("pairs", "judged", "block-links") for n in written.get(name, [0])) < len(rows)


def test_shared_values_of_blocks(monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_COLUMNS", 7)
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(-30, 30), rng.randrange(0, 40))) for _ in range(12)]
    arrays = [minhash.np.array(s, dtype="int64") for s in sets]
    got = minhash.shared_counts(arrays[:5], arrays[5:])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[5:]] for a in sets[:5]]
    assert minhash.shared_counts([], arrays).shape == (0, 12) and minhash.shared_counts(arrays[:1], arrays[:0]).shape == (1, 0)
    linked = minhash.np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 2), (2, 4), (4, 0), (3, 5)):
        linked[a, b] = linked[b, a] = True
    found = minhash.joining(linked)
    assert len(found) == 3 and all(linked[a, b] for a, b in found)


def test_sketch_shares_are_sound():
    params = minhash.NearParams(3, 85)
    assert minhash.needed(10, params) == 9 and minhash.needed(1, params) == 1
    assert 30 <= minhash.needed(1000, params) <= 40


def test_one_of_each_group_stays(docs, corpus, empty):
    doubled = docs.union(docs.where("doc_id = 3")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = minhash.keep_one(doubled)
    component, _ = plain.components([i for i, _ in corpus], [t for _, t in corpus], 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(component.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns
    assert minhash.near_duplicates(empty).count() == 0


# 7 packing

def packed_soundly(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_packing(docs, corpus, empty, file):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(WORDS)
    odd = docs.withColumn("text", F.when(F.col("doc_id") == 5, "a <|endoftext|> b\u00a0c\u3000 \u0131\u017f \r\n\t x").otherwise(F.col("text")))
    corpus = [(i, "a <|endoftext|> b\u00a0c\u3000 \u0131\u017f \r\n\t x" if i == 5 else t) for i, t in corpus]
    coder.encode_special_tokens = True
    rows = packing.pack_documents(odd.withColumn("length", F.lit("clash")), public_tokenizers.path(file), 256, with_ids=True).collect()
    packed_soundly(rows, 256)
    for i, text in corpus:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert all(r.length == 256 for r in own[1:]) and len(own) == -(-len(ids) // 256)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_long_white_space_is_packed(spark):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(WORDS)
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for file in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        pieces = packing.token_pieces(docs, public_tokenizers.path(file), 2048).groupBy("doc_id").agg(F.sum("length").alias("length")).collect()
        assert {r.doc_id: r.length for r in pieces} == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_pieces_are_the_library_ids():
    """Every code point between letters, digits, spaces and alone, and words, marks and white space mixed."""
    from tokenizers import Tokenizer
    coder, own = Tokenizer.from_file(WORDS), packing.PieceEncoder(WORDS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1{c}  {c}" for c in points[k:k + 64]) for k in range(0, 0x32000, 64)]
    rng = random.Random(5)
    texts += ["".join(rng.choice(list(" aehT's.é\n'0ß1漢😀\u200d|\t\u00a0\u3000")) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids, text


def test_exchange_of_loose_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    rng = random.Random(8)
    lengths = [rng.choice([35, 36, 50, 51, 66, 99]) for _ in range(2000)] + [100] * 30
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack_pieces(pieces, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    once = sum(len(packing.best_fit_decreasing(np.array(lengths[k::51]), 100)[2]) for k in range(51))
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= packed_soundly(rows, 100) < once


def test_lower_bounds_hold_and_are_sharp():
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5  # two fit a bin
    assert packing.lower_bound(np.zeros(101, np.int64), 100) == 0
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))])
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(packing.best_fit_decreasing(lengths, 100)[2])


# 8 sentence spans

def test_sentence_edges(corpus):
    from millwright.llm.arrays import text_bytes
    import pyarrow as pa
    texts = ["A b. C!  D? E", "", " .x. y", "no end", "a.\n\nb\n c", "\n\n", "e.g.this is one. two", "漢。字 x. "]
    data, offsets = text_bytes(pa.array(texts))
    start, end, doc = sentences.sentence_edges(data, offsets)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b, d in zip(start, end, doc) if d == i]
        assert "".join(got) == t
        assert [g for g in got if g.split()] == [p for p in plain.sentences(t) if p.split()] or t.startswith((" ", "\n"))


def test_repeated_sentence_spans_go_but_for_the_first(docs, corpus, empty):
    got = [r[0] for r in by_id(sentences.without_repeated_sentences(docs), "text")]
    want = plain.span_removal([i for i, _ in corpus], [t for _, t in corpus], 2, 20)
    assert [g or "" for g in got] == want
    assert sentences.without_repeated_sentences(empty).count() == 0


def test_short_repeats_stay(spark):
    docs = spark.createDataFrame([(1, "It is. So it was. " * 2), (2, "It is. So it was."), (3, None)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in sentences.without_repeated_sentences(docs).collect())


def test_registered_query_takes_every_run_of_sentences(spark, corpus, tmp_path):
    from millwright.llm import queries
    words = [f"w{i}" for i in range(55)]
    for i in (19, 23, 27, 31, 35):
        words[i] += "."  # 16 words in whole sentences; the outer ones run on into the text around
    rows = [(1000 + k, f"Own start {k}. Before {k} {' '.join(words)} after {k}. Own end {k}.") for k in range(3)]
    spark.createDataFrame(corpus + rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(by_id(queries.QUERIES["op8_sentence_span_dedup"](spark, str(tmp_path)), "doc_id", "text"))
    assert [("w25" in got[i]) for i in (1000, 1001, 1002)] == [True, False, False]
    want = plain.span_removal([i for i, _ in corpus + rows], [t for _, t in corpus + rows], 2, 1)
    assert [t or "" for t in got.values()] == want


# 9 toxicity and 10 quality

@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(6)
    plain_words = ["river", "stone", "walk", "green", "house", "table", "seven", "letter", "winter", "garden"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain_words) for _ in range(rng.randrange(8, 90))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        lang = rng.choice(["en", "de", None])
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "Scumbags!", "vermin"] if lang == "en" else ["drecksau", "drecksack"])
        if junk:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, None), (1001, "", "en"), (None, "river", "en")]
    labels += [(1000, None, None), (None, 1, 0), (5, labels[5][1], labels[5][2])]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
            {i: (q, t) for i, q, t in labels if i is not None})


def test_quality_of_held_out_documents(marked):
    docs, labels, truth = marked
    scored = quality.score_texts(docs.withColumn("score", F.lit("clash")), quality.train_quality(docs, labels)).collect()
    held = [r for r in scored if r.doc_id in truth and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == (truth[r.doc_id][0] == 1) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if not r.text}) == 1
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and 300 < kept.count() < 500


def test_held_out_rows_are_never_trained_on(marked):
    docs, labels, _ = marked
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train_quality(docs, labels)[0], quality.train_quality(docs, flipped)[0])
    for i in (0, 7, 41):
        assert docs.where(F.col("doc_id") == i).select(quality.held_out()).first()[0] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_averages_of_features_are_whole_text_averages():
    from millwright.llm.arrays import text_bytes
    from millwright.llm.features import counted, quality_groups, summed, toxicity_groups
    import pyarrow as pa
    texts = ["a bb a", "", "x", "Größe, größe!", "one two three " * 50]
    data, offsets = text_bytes(pa.array(texts))
    table = np.random.default_rng(0).normal(size=(1 << 12, 2))
    for groups in (quality_groups, toxicity_groups):
        doc, bucket, times, total = counted(groups(data, offsets, 12), 5)
        sums, n = summed(groups(data, offsets, 12), table, 5)
        assert (n == total).all()
        for i, t in enumerate(texts):
            alone = text_bytes(pa.array([t]))
            one, count = summed(groups(*alone, 12), table, 1)
            assert np.allclose(one[0], sums[i]) and count[0] == n[i]
            assert np.allclose((table[bucket[doc == i]] * times[doc == i, None]).sum(axis=0), sums[i])


def test_toxicity_chain(marked):
    docs, labels, truth = marked
    model = toxicity.train_toxicity(docs, labels)
    assert [len(w) for w in model[1]] == [len(model[0]) + k + 1 for k in range(5)]  # each category sees the earlier ones
    scored = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in scored if r.doc_id in truth and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.toxic >= toxicity.DEFAULTS.threshold) == (truth[r.doc_id][1] == 1) for r in held]
    assert sum(right) / len(right) > 0.97
    english = [r for r in held if r.lang == "en" and truth[r.doc_id][1] == 1]
    assert sum(r.insult_en > r.insult_de for r in english) > 0.9 * len(english)
    assert all(r.toxic < 0.5 for r in scored if not r.text)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 350 < kept.count() < 560


def test_samples_are_whole_and_held_once(marked):
    import pyarrow as pa
    from millwright.llm.features import quality_groups
    docs, labels, _ = marked
    assert (quality.DEFAULTS.sample, toxicity.DEFAULTS.sample) == (3_000, 8_000)
    sample = quality.labelled_sample(docs, labels.select("doc_id", "quality"), 3_000)
    examples, marks = quality.sampled_features(sample, quality_groups, 12, ["quality"])
    assert len(examples) == len(marks) == 601

    def owner(array):
        while isinstance(array, (np.ndarray, memoryview)):
            array = array.base if isinstance(array, np.ndarray) else array.obj
        return array

    assert all(isinstance(owner(a), pa.Buffer) for example in examples for a in example if len(a))  # no copy beside Arrow's


def test_labels_of_absent_documents_use_up_no_limit(marked, spark):
    docs, labels, _ = marked
    absent = spark.range(10_000, 15_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    for table in (labels, labels.union(absent)):
        rows = quality.labelled_sample(docs, table, 100).select("id", "toxic").collect()
        assert len(rows) == 100 and all(r.id <= 1000 for r in rows)


def test_out_of_fold_probabilities_feed_the_chain():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, size=(300, 4)).astype(float)
    marks = np.column_stack((x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0))).astype(int)
    chain = toxicity.fit_chain(x, marks, toxicity.DEFAULTS)
    assert chain[1][4] > 0  # the earlier category speaks for the later one


def test_classifiers_without_labels(marked, empty):
    docs, labels, _ = marked
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score_texts(docs, quality.train_quality(docs, none)).collect()} == {0.5}
    assert toxicity.drop_toxic(docs, none.limit(0)).count() in (0, docs.count())
    assert quality.keep_quality(empty, labels).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0
