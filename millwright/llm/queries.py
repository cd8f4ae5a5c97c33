"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from millwright.llm.bpe import round_trip_digests
from millwright.llm.divergence import divergence_audit
from millwright.llm.minhash import NearParams, near_duplicates
from millwright.llm.mixing import mix_sources
from millwright.llm.neighbours import nearest
from millwright.llm.packing import pack_documents
from millwright.llm.quality import DEFAULTS as QUALITY, held_out, score_texts, train_quality
from millwright.llm.repeats import removal_digests
from millwright.llm.sentences import SpanParams, without_repeated_sentences
from millwright.llm.sharding import shard_documents
from millwright.llm.topk import exact_topk
from millwright.llm.toxicity import CATEGORIES, DEFAULTS as TOXICITY, score_toxicity, train_toxicity
from millwright.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@_query
def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over eight shards of near-equal bytes, equal texts together where the tolerance allows it."""
    docs = _documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shard_documents(docs, carry=["doc_id", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_approximation_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLES["op2_approximation_file_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op3_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector among all others, by relaxed vantage-point trees."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@_query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and what they decode to, as checksums."""
    return round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op6_bottom_k_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by three-word shingles and a similarity of 0.85, by component."""
    return near_duplicates(_documents(spark, sf_dir), NearParams(words=3, percent=85))


@_query
def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048."""
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probability of every category for every document, and the decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), *CATEGORIES[:-1], F.col("toxic").alias("score"),
                         (F.col("toxic") >= TOXICITY.threshold).cast("int").alias("predicted"))


@_query
def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of good quality for every document, by averaged subword vectors."""
    docs = _documents(spark, sf_dir)
    scored = score_texts(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY.threshold).cast("int").alias("predicted"))


@_query
def op4_merged_transform_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of every 400-byte string that starts at two places or more, as counts and a checksum."""
    return removal_digests(_documents(spark, sf_dir), 400)


@_query
def op8_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of any run of two or more, however short, that stands at an earlier place too."""
    return without_repeated_sentences(_documents(spark, sf_dir), SpanParams(words=1))  # runs of two cover all longer ones


@_query
def op11_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first eight whitened components, from the different vectors weighted by how often they stand."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), carry=["vec_id"])


@_query
def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of a language differs from each other one, and the ten terms it uses most beyond its language."""
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLES["op12_divergence_audit"] = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT z.*, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM z JOIN v USING (lang)),
l AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM z GROUP BY lang, term) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM t WHERE part = 'pair' OR rank <= 10
"""


@_query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes, repeats counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs, carry=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


ORACLES["op13_source_mix"] = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             concat_ws(':', 'mix', doc_id, md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM s),
a AS (SELECT *, (SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
l AS (SELECT k, rest, ws FROM a WHERE w * rest <= 3 * source_size * ws ORDER BY k LIMIT 1),
t AS (SELECT a.source, a.source_size, CASE WHEN a.k < l.k THEN CAST(3 * a.source_size AS DOUBLE) ELSE CAST(a.w * l.rest AS DOUBLE) / CAST(l.ws AS DOUBLE) END AS target FROM a, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5(concat_ws(':', key, row_number() OVER (PARTITION BY key ORDER BY size) - 1)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS drawn
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken, source FROM r
"""
