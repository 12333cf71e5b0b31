"""Queries over the given tables, one per operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockcast.llm import content_sort, credentials, licenses, minhash_forest, mixing, negatives, pieces, quality, sharding, simhash, suffixes, topk, whitening

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ENTROPY_SHARE, REPETITION = 0.97, 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixture(table(spark, sf_dir, "documents"), entropy_share=ENTROPY_SHARE, repetition=REPETITION)
    return drawn.select(F.col("id").alias("doc_id"), "source", "tokens", F.round("weight", 9).alias("weight"), "block", "place")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(credentials.written("base"), 256).alias("base_sha256"),
        credentials.written("spans").alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"), largest=True).withColumnRenamed("id", "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.withColumnRenamed("id", "vec_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated(table(spark, sf_dir, "documents"), window=50)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), MODEL).withColumnRenamed("id", "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, net).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
    long = found.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error",
    )


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_temperature_mixing, op2_secret_scan, op3_simhash, op4_exact_dedup, op5_license_scan, op6_exact_topk, op7_suffix_dedup,
        op8_sharding, op9_sentencepiece, op10_quality, op11_whitening, op12_minhash_forest, op13_hard_negatives,
    )
}

OP1_SQL = rf"""
WITH slim AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), src AS (
    SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE / sum(sum(tokens)) OVER () AS p FROM slim GROUP BY source
), powered AS (
    SELECT j, tokens, pow(p, j / {mixing.GRID}::DOUBLE) AS x FROM src, range({mixing.GRID + 1}) AS r(j) WHERE tokens > 0
), steps AS (
    SELECT j, ln(sum(x)) - sum(x * ln(x)) / sum(x) AS entropy, max(x / tokens) / min(x / tokens) AS repetition FROM powered GROUP BY j
), chosen AS (
    SELECT greatest(
        coalesce(max(j) FILTER (entropy >= {ENTROPY_SHARE} * (SELECT entropy FROM steps WHERE j = 0) - 1e-9), 0),
        coalesce(max(j) FILTER (repetition > {REPETITION} + 1e-9), -1) + 1) / {mixing.GRID}::DOUBLE AS a FROM steps
), raised AS (
    SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(p, a) ELSE 0 END AS x FROM src, chosen
), sums AS (
    SELECT sum(x) AS z, sum(x) / min(x / tokens) AS spread FROM raised WHERE tokens > 0
), plan AS (
    SELECT source, tokens, round(x / z, 9) AS weight, round(x / z * spread)::BIGINT AS budget FROM raised, sums
), keyed AS (
    SELECT doc_id, s.source, s.tokens, weight,
        CASE WHEN p.tokens > 0 THEN budget // p.tokens ELSE 1 END AS whole, CASE WHEN p.tokens > 0 THEN budget % p.tokens ELSE 0 END AS rest
    FROM slim s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), placed AS (
    SELECT *, ('0x' || substr(md5(concat_ws('|', '7', coalesce(source, ''), whole, coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS k FROM keyed
), counted AS (
    SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM placed
), edges AS (
    SELECT *, min(k) FILTER (rest > 0 AND upto >= rest) OVER (PARTITION BY source) AS edge FROM counted
), drawn AS (
    SELECT doc_id, source, tokens, weight, unnest(range(whole + CASE WHEN k <= edge THEN 1 ELSE 0 END)) AS block FROM edges
)
SELECT doc_id, source, tokens, weight, block,
    ('0x' || substr(md5(concat_ws('|', '7', coalesce(source, ''), block, coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS place
FROM drawn
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: the rest need hashes, patterns or loops that this SQL has not; tests hold them against plain versions
ORACLES: dict[str, str] = {"op1_temperature_mixing": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_exact_topk": OP6_SQL, "op13_hard_negatives": OP13_SQL}
