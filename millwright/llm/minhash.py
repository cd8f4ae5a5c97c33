"""Near-duplicate documents by bottom-k sketches from one hash function.

The sketch of a document is the ``k`` smallest hashes of its word shingles. Equal shingle sets become one node. Inverted
lists of retained values bring nodes together, the ``k`` smallest values of two sketches' union estimate their
similarity, and full sets confirm it.

Two similar sets share many retained values (all but one pair in a thousand million share as many as ``needed`` says, and all
pairs of sets that fit their sketches do), so a node looks only into the lists of its ``r - needed + 1`` rarest values:
of two sketches that share that many, these prefixes share one. Values that are common in the corpus are therefore looked
up only by documents made mostly of such values, and those once more by the rarest values of their full sets.

Lists stay linear: a short list gives all its pairs, a long one only the pairs of a few leaders with all others. Found
links are made into components. A list that lies in one component is done. Of the others, nodes outside the component
that has most of the list stay open, and the next leaders come from them; nodes of one component are never compared.
So no link between different components is lost, and no list gives the square of its length in rows. What leaders leave
open (texts just under the limit to each other) is compared in blocks of full sets, of which only joining links come out:
the comparisons of such a group are still the square of its size, but what is written and held is not.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.arrays import Prefixes, lowered, mixed, runs, text_bytes, words
from millwright.session import scratch_table

BROADCAST_ROWS = 500_000  # identifiers, 8 bytes each; beyond this the join shuffles
BLOCK_NODES = 1_024  # of a list, compared with as many others at a time
BLOCK_VALUES = 1 << 18  # in the full sets of a block, in the mean
BLOCK_COLUMNS = 4_096  # values that are a matrix at a time
BLOCK_ROWS = 1 << 13  # nodes of blocks that go to one task


@dataclass(frozen=True)
class NearParams:
    words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    k: int = 64
    short_list: int = 32
    long_list: int = 1_000  # a list up to this length has `leaders` leaders in a round, a longer one `few_leaders`
    leaders: int = 16  # in the first round; eight times as many after it, when few nodes are still open
    few_leaders: int = 4
    miss: float = 1e-9
    rounds: int = 2  # with leaders; of lists still open then, every node left is compared with the other components


DEFAULTS = NearParams()


def surely(r: int, params: NearParams) -> int:
    """Of the ``r`` smallest values of two linked sets' union, how many are in both but for a chance of ``miss``."""
    share, below = params.percent / 100, 0.0
    for s in range(r + 1):
        below += math.comb(r, s) * share ** s * (1 - share) ** (r - s)
        if below > params.miss:
            return s
    return r


def needed(n: int, params: NearParams) -> int:
    """Retained values that the sketches of two linked sets, one of size ``n``, are sure to share."""
    if n <= params.percent * params.k // 100:  # the other set fits its sketch too
        return -(-params.percent * n // 100)
    return surely(min(n, params.k), params)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each document's distinct shingles, ascending; where each document's begin and the last end)."""
    count = len(offsets) - 1
    low = lowered(data)
    start, end, doc = words(low, offsets)
    name = Prefixes(low).of(start, end)
    bounds = np.searchsorted(doc, np.arange(count + 1))
    held = np.diff(bounds)
    hashes, owner = [], []
    if len(name) >= size:
        run = np.zeros(len(name) - size + 1, dtype=np.uint64)
        for i in range(size):
            run = mixed(run + name[i:len(name) - size + 1 + i] + np.uint64(i))
        whole = doc[:len(run)] == doc[size - 1:]
        hashes.append(run[whole])
        owner.append(doc[:len(run)][whole])
    few = np.flatnonzero((held > 0) & (held < size))
    if len(few):
        single = np.full(len(few), size, dtype=np.uint64)
        for i in range(size - 1):
            more = held[few] > i
            single[more] = mixed(single[more] * np.uint64(3) + name[bounds[:-1][few[more]] + i])
        hashes.append(single)
        owner.append(few)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(count + 1, np.int64)
    hashes, owner = np.concatenate(hashes) >> np.uint64(1), np.concatenate(owner)  # never negative as a signed number
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return hashes, np.searchsorted(owner, np.arange(count + 1))


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, params: NearParams) -> DataFrame:
    """(id, n, h1, h2, sketch) of every row of ``docs`` (id, text): size and checksum of its shingle set, and its smallest hashes."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in runs(offsets):
                values, cuts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], params.words)
                n = np.diff(cuts)
                sums = np.zeros((2, len(values) + 1), dtype=np.uint64)
                np.cumsum(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
                np.cumsum(mixed(values + np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
                kept = np.minimum(n, params.k)
                ends = np.concatenate(([0], np.cumsum(kept)))
                at = np.arange(ends[-1]) - np.repeat(ends[:-1] - cuts[:-1], kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n, pa.int32()), *(pa.array((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64)) for s in sums),
                     _lists(values[at], ends)], ["id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n int, h1 long, h2 long, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, params: NearParams) -> DataFrame:
    """(node, shingles) of the documents named in ``wanted`` (node)."""
    few = wanted.count() <= BROADCAST_ROWS
    chosen = docs.join((F.broadcast(wanted) if few else wanted).withColumnRenamed("node", "id"), "id", "left_semi")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in runs(offsets):
                values, cuts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], params.words)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), _lists(values, cuts)], ["node", "shingles"])

    return chosen.mapInArrow(run, f"node {docs.schema['id'].dataType.simpleString()}, shingles array<long>")


def _rarest(values: DataFrame, size, kept) -> DataFrame:
    """(value, node) of the ``kept`` rarest of each node's values, ``size`` in all; values of one node only are left out."""
    often = values.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("node")  # the values of one document
    ranked = values.join(often, "value").withColumn("rank", F.row_number().over(own.orderBy("often", "value"))).withColumn("common", F.count("*").over(own))
    return ranked.where(size - F.col("common") + F.col("rank") <= kept).select("value", "node")


def _prefix_lists(nodes: DataFrame, docs: DataFrame, params: NearParams) -> DataFrame:
    """(value, node): the inverted lists that a node must look into, lists of one left out.

    First those of its rarest retained values. A node that gets into a long list this way is made mostly of values that
    are common in the corpus, be it a copy among many or a text around a common passage. These nodes are looked at
    again by their full sets: two linked sets share one of the rarest ``n - needed + 1`` of all their values, counted
    among these nodes, and that is a far smaller share of the values than a sketch allows to tell.
    """
    retained = F.least("n", F.lit(params.k))
    sizes = [F.lit(min(n, params.k) - needed(n, params) + 1) for n in range(params.k + 1)]
    lists = scratch_table(_rarest(nodes.select("node", "n", F.explode("sketch").alias("value")), retained, F.element_at(F.array(*sizes), retained + 1)), "retained")
    length = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    joined = lists.join(length, "value")
    common = joined.where(F.col("m") > params.short_list).select("node").distinct()
    sets = full_sets(docs, common, params).select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    whole = _rarest(scratch_table(sets, "common-sets"), F.col("n"), F.col("n") - F.ceil(F.col("n") * params.percent / 100) + 1)
    return joined.where(F.col("m") <= params.short_list).select("value", "node").unionByName(whole.select((-1 - F.col("value")).alias("value"), "node").distinct())


def _similar_enough(a: str, b: str, params: NearParams):
    """Of the k smallest values of both sketches, enough are in both; where the union has fewer, it is exact."""
    every = F.array_union(a, b)
    union = F.slice(F.array_sort(every), 1, params.k)
    both = F.size(F.array_intersect(F.array_intersect(F.col(a), F.col(b)), union))
    return F.when(F.size(every) < params.k, both * 100 >= F.size(every) * params.percent).otherwise(both >= surely(params.k, params))


def _judged(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, params: NearParams) -> DataFrame:
    """(a, b, both, either) with exact sizes, for the pairs that their sketches do not rule out."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").where(F.greatest("na", "nb") * params.percent <= F.least("na", "nb") * 100)
    near = scratch_table(near.where(_similar_enough("sa", "sb", params)).select("a", "b"), "near-pairs")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = scratch_table(full_sets(docs, wanted, params), "full-sets")
    counted = near.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    counted = counted.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return scratch_table(counted, "judged")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values every set of ``left`` shares with every one of ``right``; the sets hold a value once."""
    values, size = [], []
    for sets in (left, right):
        values.append(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        size.append(np.array([len(x) for x in sets], dtype=np.int64))
    both = np.intersect1d(*values)
    at, owner = [], []
    for v, n in zip(values, size):
        place = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        hit = np.flatnonzero(both[place] == v) if len(both) else np.zeros(0, np.int64)
        order = hit[np.argsort(place[hit], kind="stable")]
        at.append(place[order])
        owner.append(np.repeat(np.arange(len(n)), n)[order])
    counts = np.zeros((len(left), len(right)), dtype=np.int32)
    for first in range(0, len(both), BLOCK_COLUMNS):
        marks = []
        for k, n in enumerate(size):
            a, b = np.searchsorted(at[k], (first, first + BLOCK_COLUMNS))
            mark = np.zeros((len(n), min(BLOCK_COLUMNS, len(both) - first)), dtype=np.float32)
            mark[owner[k][a:b], at[k][a:b] - first] = 1
            marks.append(mark)
        counts += (marks[0] @ marks[1].T).astype(np.int32)  # whole numbers up to BLOCK_COLUMNS, exact
    return counts


def joining(linked: np.ndarray) -> list[tuple[int, int]]:
    """As many links of a symmetric matrix as connect all that its links connect."""
    new, out = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not new[start]:
            continue
        new[start], ahead = False, [start]
        while ahead:
            at = ahead.pop()
            for other in np.flatnonzero(linked[at] & new).tolist():
                new[other] = False
                out.append((at, other))
                ahead.append(other)
    return out


def _block_links(lists: DataFrame, nodes: DataFrame, docs: DataFrame, params: NearParams) -> DataFrame:
    """(a, b) of linked nodes of different components that are in one list and of which one seeks; enough to connect all such.

    ``lists``: value, node, component, seeks. A list is dealt into blocks, and every two blocks of it are compared by one
    task, full set by full set. Of lists with the same nodes one is compared.
    """
    own = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    sized = lists.join(nodes.select("node", "n"), "node")
    about = sized.groupBy("value").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.count_if("seeks").alias("seekers"), *own).where("m > 1 and seekers > 0")
    about = about.groupBy("m", "x0", "x1").agg(F.min("value").alias("value"), F.min("size").alias("size"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_NODES, F.col("size") / BLOCK_VALUES)).cast("int")
    dealt = lists.join(about.select("value", blocks.alias("blocks")), "value").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = scratch_table(dealt.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "seeks"), "blocks")
    sets = scratch_table(full_sets(docs, rows.select("node").distinct(), params), "block-sets")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK_ROWS))

    def compared(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j, own = (table.column(c).to_numpy() for c in ("i", "j", "own"))
        first = np.flatnonzero(own == i[0])
        second = first if i[0] == j[0] else np.flatnonzero(own == j[0])
        sets = [v.values.to_numpy() for v in table.column("shingles")]
        size = np.array([len(v) for v in sets], dtype=np.int64)
        shared = shared_counts([sets[k] for k in first], [sets[k] for k in second])
        seeks = table.column("seeks").to_numpy()
        part = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        near = shared * np.int64(100) >= (size[first][:, None] + size[second][None, :] - shared) * params.percent
        near &= (part[first][:, None] != part[second][None, :]) & (seeks[first][:, None] | seeks[second][None, :])
        linked = np.zeros((len(own), len(own)), dtype=bool)
        linked[np.ix_(first, second)] = near
        linked |= linked.T
        found, node = joining(linked), table.column("node").combine_chunks()
        return pa.Table.from_arrays([node.take(pa.array([f[k] for f in found], pa.int64())) for k in range(2)], ["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    met = rows.join(sets, "node").repartition(tasks, "value", "i", "j").groupBy("value", "i", "j").applyInArrow(compared, f"a {kind}, b {kind}")
    return scratch_table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "block-links")


def links(nodes: DataFrame, docs: DataFrame, params: NearParams = DEFAULTS) -> DataFrame:
    """(a, b) of nodes of one component, enough of them to connect every two that are linked. ``nodes``: node, n, sketch, of different sets."""
    lists = scratch_table(_prefix_lists(nodes, docs, params).withColumn("component", F.col("node")).withColumn("seeks", F.lit(True)), "lists")
    found, known = None, None
    for round_ in range(params.rounds):
        about = lists.groupBy("value").agg(F.count("*").alias("m"), F.count_if("seeks").alias("seekers"), F.min(F.when(F.col("seeks"), F.col("node"))).alias("least")).where("m > 1 and seekers > 0")
        share = F.ceil(F.col("seekers") / F.when(F.col("m") <= params.long_list, params.leaders * (8 if round_ else 1)).otherwise(params.few_leaders))
        chosen = (F.col("node") == F.col("least")) | (F.pmod(F.xxhash64("node", F.lit(round_)), share) == 0)
        leads = F.col("seeks") & ((F.col("m") <= params.short_list) | chosen)
        joined = lists.join(about, "value").withColumn("leads", leads)
        some, every = joined.where("leads").alias("x"), joined.alias("y")
        apart = (F.col("x.component") != F.col("y.component")) & (F.col("x.node") != F.col("y.node")) & (~F.col("y.leads") | (F.col("x.node") < F.col("y.node")))
        met = some.join(every, F.col("x.value") == F.col("y.value")).where(apart)
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = scratch_table(pairs, "pairs")
        judged = _judged(pairs, nodes, docs, params)
        good = judged.where(F.col("both") * 100 >= F.col("either") * params.percent).select("a", "b")
        found, known = (good, pairs) if found is None else (found.union(good), known.union(pairs))
        # what stays open: in long lists, nodes outside the component that has most of the list, and all that did not lead yet
        rest = joined.where(F.col("m") > params.short_list).where(~F.col("leads")).select("value", "node")
        if rest.limit(1).count() == 0:
            return found
        label = components(found)
        found = label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))  # one a node, however many links it has
        named = rest.join(label, "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
        sizes = named.groupBy("value", "component").agg(F.count("*").alias("size"))
        most = sizes.groupBy("value").agg(F.max("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
        largest = sizes.join(most, ["value", "size"]).groupBy("value").agg(F.min("component").alias("largest"))
        lists = scratch_table(named.join(largest, "value").select("value", "node", "component", (F.col("component") != F.col("largest")).alias("seeks")), "lists")
        if lists.limit(1).count() == 0:
            return found
    last = _block_links(lists, nodes, docs, params)
    return last if found is None else found.union(last)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Labels go to neighbours and are then shortened through the labels' own labels, until nothing changes.
    """
    both = scratch_table(edges.union(edges.select("b", "a")).distinct(), "edges")
    label = scratch_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        known = label.select(F.col("node").alias("b"), F.col("component").alias("offered"))
        offered = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("offered").alias("offered"))
        lower = label.join(offered, "node").select("node", F.col("component").alias("old"), F.least("component", "offered").alias("component"))
        shorter = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = scratch_table(lower.join(shorter, "component").select("node", "old", F.least("component", "root").alias("component")), "labels")
        if new.where("old <> component").limit(1).count() == 0:
            return new.select("node", "component")
        label = new.select("node", "component")


def near_duplicates(docs: DataFrame, params: NearParams = DEFAULTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the smallest identifier reachable by links, and whether it is its own.

    Texts without words, null and empty ones have no shingles and no links. A text with fewer words than a shingle has
    one of all its words. Rows that share an identifier are one document's rows. A null identifier is never linked: its
    component is null and it is kept. Only the identifier and the text are read, so other columns cannot clash.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = scratch_table(sketches(texts, params), "sketches")
    filled = drawn.where("n > 0 and id is not null")
    classes = scratch_table(filled.groupBy("n", "h1", "h2").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch")), "classes")
    label = components(links(classes.select("node", "n", "sketch"), texts.where("id is not null"), params))
    named = classes.join(label, "node", "left").select("n", "h1", "h2", F.coalesce("component", "node").alias("component"))
    rows = drawn.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: NearParams = DEFAULTS, id_col: str = "doc_id") -> DataFrame:
    """One document of every group of near duplicates, that of the smallest identifier, with the columns ``docs`` has.

    A repeated row is kept once; rows without an identifier are all kept.
    """
    kept = near_duplicates(docs, params, id_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__kept_id")).distinct()
    one = docs.join(kept, F.col(id_col) == F.col("__kept_id"), "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(F.col(id_col).isNull()))
