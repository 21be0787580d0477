"""Corpus preparation over the documents and embeddings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import words
from ..operators import corpus
from ..sources.tables import given, spread
from .catalog import query, sql_words, with_ctes

ARTICLES = "articles AS (SELECT doc_id AS article_id, source AS title, text FROM documents)"
SPLIT = f"split AS (SELECT article_id, title, {sql_words('text')} AS w FROM articles)"
CHUNKS = """chunks AS (
  SELECT article_id, title, j AS chunk_no, w[j * 200 + 1 : j * 200 + 200] AS run
  FROM split, unnest(range(0, (len(w) + 199) // 200)) AS t(j)
),
kept AS (
  SELECT article_id, chunk_no, len(run) AS n_words, array_to_string(run, ' ') AS chunk,
         title || ': ' || array_to_string(run, ' ') AS text
  FROM chunks WHERE len(run) >= 30
)"""


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return spread(given(spark, folder, "documents").select(
        F.col("doc_id").alias("article_id"), F.col("source").alias("title"), "text"
    ))


@query("b1_word_split", with_ctes(
    "SELECT article_id, len(w)::BIGINT AS n_words, w[1] AS first_word, w[len(w)] AS last_word FROM split",
    ARTICLES, SPLIT))
def word_split(spark: SparkSession, folder: str) -> DataFrame:
    split = articles(spark, folder).select("article_id", words(F.col("text")).alias("w"))
    return split.select(
        "article_id", F.size("w").cast("bigint").alias("n_words"),
        F.get("w", 0).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"),
    )


@query("b2_b3_word_chunks", with_ctes(
    "SELECT article_id, chunk_no::BIGINT AS chunk_no, n_words::BIGINT AS n_words, md5(chunk) AS chunk_md5 FROM kept",
    ARTICLES, SPLIT, CHUNKS))
def word_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk(articles(spark, folder)).select(
        "article_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("n_words").cast("bigint").alias("n_words"), F.md5("chunk").alias("chunk_md5"),
    )


@query("b4_titled_passages", with_ctes(
    "SELECT article_id, chunk_no::BIGINT AS chunk_no, md5(text) AS text_md5 FROM kept", ARTICLES, SPLIT, CHUNKS))
def titled_passages(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.titled(corpus.chunk(articles(spark, folder))).select(
        "article_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("text").alias("text_md5")
    )


@query("b5_article_limit", with_ctes(
    "SELECT article_id, count(*) AS n_passages FROM kept WHERE article_id IN "
    "(SELECT article_id FROM articles ORDER BY article_id LIMIT 500) GROUP BY article_id",
    ARTICLES, SPLIT, CHUNKS))
def article_limit(spark: SparkSession, folder: str) -> DataFrame:
    first = corpus.first_articles(articles(spark, folder), 500)
    return corpus.chunk(first).groupBy("article_id").agg(F.count(F.lit(1)).alias("n_passages"))


@query("b6_passage_ids", with_ctes(
    "SELECT row_number() OVER (ORDER BY article_id, chunk_no) - 1 AS passage_idx, article_id, "
    "chunk_no::BIGINT AS chunk_no, md5(text) AS text_md5 FROM kept", ARTICLES, SPLIT, CHUNKS))
def passage_ids(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.numbered_passages(articles(spark, folder)).select(
        "passage_idx", "article_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.md5("text").alias("text_md5"),
    )


@query("b7_corpus_counts", with_ctes(
    "SELECT (SELECT count(*) FROM articles) AS n_articles, count(DISTINCT article_id) AS n_articles_kept, "
    "count(*) AS n_passages FROM kept", ARTICLES, SPLIT, CHUNKS))
def corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    source = articles(spark, folder)
    return corpus.corpus_counts(source, corpus.chunk(source))


@query("b8_encode_passages", with_ctes(
    "SELECT article_id, chunk_no::BIGINT AS chunk_no, "
    f"least(len({sql_words('lower(text)')}), 256)::BIGINT AS n_tokens, "
    "256::BIGINT AS dim, 1.0::DOUBLE AS length FROM kept", ARTICLES, SPLIT, CHUNKS))
def encode_passages(spark: SparkSession, folder: str) -> DataFrame:
    encoded = corpus.encode_hashed(corpus.titled(corpus.chunk(articles(spark, folder))), "text")
    return encoded.select(
        "article_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.size("embedding").cast("bigint").alias("dim"),
        F.round(vectors.norm(F.col("embedding")), 5).alias("length"),
    )


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding read as eight token vectors of eight numbers, some of them masked."""
    at = F.sequence(F.lit(0), F.lit(7))
    return given(spark, folder, "embeddings").select(
        "vec_id",
        F.transform(at, lambda t: F.slice("embedding", t * 8 + 1, 8)).alias("tokens"),
        F.transform(at, lambda t: F.when((F.col("vec_id") + t) % 3 == 0, 0).otherwise(1)).alias("mask"),
    )


TOKENS = """toks AS (
  SELECT vec_id, t, d, embedding[t * 8 + d + 1]::DOUBLE AS value,
         CASE WHEN (vec_id + t) % 3 = 0 THEN 0 ELSE 1 END AS mask
  FROM embeddings, unnest(range(8)) AS a(t), unnest(range(8)) AS b(d)
),
pooled AS (SELECT vec_id, d, sum(value * mask) / greatest(sum(mask), 1e-9) AS pooled FROM toks GROUP BY vec_id, d)"""


@query("b9_masked_mean", with_ctes(
    "SELECT vec_id, d::BIGINT AS dim, round(pooled, 7) AS pooled FROM pooled", TOKENS))
def masked_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.pool_tokens(token_vectors(spark, folder), "tokens", "mask")
    return rows.select("vec_id", F.posexplode("pooled").alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("v", 7).alias("pooled")
    )


@query("b9_masked_mean_long", with_ctes(
    "SELECT vec_id, d::BIGINT AS dim, round(pooled, 7) AS pooled FROM pooled", TOKENS))
def masked_mean_long(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_vectors(spark, folder).select(
        "vec_id", "mask", F.posexplode("tokens").alias("t", "token")
    ).select("vec_id", F.get("mask", F.col("t")).alias("m"), F.posexplode("token").alias("dim", "value"))
    return corpus.pool_token_rows(rows, ["vec_id"], "dim", "value", "m").select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("pooled", 7).alias("pooled")
    )


@query("b10_unit_vectors", with_ctes(
    "SELECT vec_id, d::BIGINT AS dim, round(pooled / greatest(sqrt(sum(pooled * pooled) OVER (PARTITION BY vec_id)), "
    "1e-12), 7) AS value FROM pooled", TOKENS))
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.pool_tokens(token_vectors(spark, folder), "tokens", "mask")
    return rows.select("vec_id", F.posexplode("embedding").alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("v", 7).alias("value")
    )
