"""Which passages answer a query however it is rewritten?

Retrieval for a query and its five rewrites, one pool per query, a mark for every
(rewrite, passage) pair, the mean mark per passage, one row per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marking, pool, retrieval
from ..session import settle, settle_last
from ..sources.tables import given
from .catalog import query, with_ctes
from .retrieval_queries import CLEAN, K, MOVED, clean_hits, perturbed_hits, perturbed_vectors, top_sql

MIN_DOT = 0.2

CHAIN = [CLEAN, MOVED, top_sql("clean_top", "clean"), top_sql("perturbed_top", "perturbed"), f"""
pool AS (SELECT DISTINCT query_idx, passage_idx FROM
  (SELECT query_idx, passage_idx FROM clean_top UNION ALL SELECT query_idx, passage_idx FROM perturbed_top)),
pairs AS (
  SELECT p.query_idx, p.passage_idx, v.pert_idx,
         a.label = b.label AND round(list_dot_product(v.e, b.embedding::DOUBLE[]), 6) >= {MIN_DOT} AS correct
  FROM pool p JOIN perturbed v USING (query_idx)
  JOIN embeddings a ON a.vec_id = p.query_idx JOIN embeddings b ON b.vec_id = p.passage_idx
),
scores AS (
  SELECT query_idx, passage_idx, count(*) FILTER (correct) / count(*) AS robustness FROM pairs GROUP BY ALL
)"""]


def marked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the pooled passages and all rewrites, marked by label and closeness."""
    def flat(hits: DataFrame) -> DataFrame:
        return hits.select(
            "query_idx", "rank", "passage_idx", F.lit(None).cast("bigint").alias("idx"),
            F.lit(None).cast("string").alias("text"), "score", *[c for c in hits.columns if c == "pert_idx"],
        )

    clean = flat(clean_hits(spark, folder).drop("pert_idx"))
    perturbed = flat(perturbed_hits(spark, folder))
    once = pool.first_occurrence(pool.with_key(pool.union_candidates(clean, perturbed)))
    given_rows = given(spark, folder, "embeddings")
    labels = given_rows.select("vec_id", "label")
    docs = settle(
        once.select("query_idx", "doc_key", "passage_idx")
        .join(labels.select(F.col("vec_id").alias("query_idx"), F.col("label").alias("_a")), "query_idx")
    )
    # A passage brings its label with its vector, so pairs meet no further table.
    held = given_rows.select(F.col("vec_id").alias("passage_idx"), "embedding", F.col("label").alias("_b"))
    scored = retrieval.rescore(docs, perturbed_vectors(spark, folder), held, ["query_idx"], carry=["pert_idx", "_b"])
    return scored.withColumn("correct", (F.col("_a") == F.col("_b")) & (F.col("scoring_score") >= MIN_DOT)).drop("_a", "_b")


@query("robust_passages", with_ctes(
    "SELECT query_idx, count(*) AS n_docs, count(*) FILTER (robustness = 1) AS n_robust, "
    "count(*) FILTER (robustness = 0) AS n_misleading, round(avg(robustness), 9) AS mean_robustness "
    "FROM scores GROUP BY query_idx", *CHAIN))
def robust_passages(spark: SparkSession, folder: str) -> DataFrame:
    scores = marking.robustness(marked_pairs(spark, folder))
    return scores.groupBy("query_idx").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("n_correct") == F.col("n_marks")).alias("n_robust"),
        F.count_if(F.col("n_correct") == 0).alias("n_misleading"),
        F.round(F.avg("robustness"), 9).alias("mean_robustness"),
    )


@query("robust_pool", with_ctes(
    "SELECT query_idx, passage_idx, round(robustness, 9) AS robustness FROM scores", *CHAIN))
def robust_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The soft score of every pooled passage."""
    marks = settle_last(spark, lambda: marked_pairs(spark, folder).select("query_idx", "passage_idx", "doc_key", "correct"))
    ids = marks.select("query_idx", "doc_key", "passage_idx").distinct()
    return marking.robustness(marks).join(ids, ["query_idx", "doc_key"]).select(
        "query_idx", "passage_idx", F.round("robustness", 9).alias("robustness")
    )
