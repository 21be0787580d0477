"""Retrieval over the embeddings table: every vector is a passage and a query.

The five rewrites of a query are its vector moved towards five other ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cell_index, queryset, retrieval
from ..session import scratch_path, settle
from ..sources.tables import given, spread
from .catalog import query, with_ctes

K = 10
N_CELLS = 16

CLEAN = """clean AS (SELECT vec_id AS query_idx, 0 AS pert_idx, embedding::DOUBLE[] AS e FROM embeddings),
passages AS (SELECT vec_id AS passage_idx, embedding::DOUBLE[] AS e FROM embeddings)"""
MOVED = """moved AS (
  SELECT a.vec_id AS query_idx, s AS pert_idx,
         list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE + 0.5 * b.embedding[i]::DOUBLE) AS m
  FROM embeddings a, unnest(range(5)) AS r(s), embeddings b
  WHERE b.vec_id = (7 * a.vec_id + 13 * (s + 1)) % (SELECT count(*) FROM embeddings)
),
perturbed AS (
  SELECT query_idx, pert_idx, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS e FROM moved
)"""


def top_sql(name: str, source: str, k: int = K) -> str:
    return f"""{name} AS (
  SELECT query_idx, pert_idx, passage_idx, score, row_number() OVER (
           PARTITION BY query_idx, pert_idx ORDER BY score DESC, passage_idx) - 1 AS rank
  FROM (SELECT q.query_idx, q.pert_idx, p.passage_idx, round(list_dot_product(q.e, p.e), 6) AS score
        FROM {source} q, passages p)
  QUALIFY rank < {k}
)"""


CLEAN_TOP = [CLEAN, top_sql("clean_top", "clean")]
PERTURBED_TOP = [CLEAN, MOVED, top_sql("perturbed_top", "perturbed")]
HITS = "SELECT query_idx, pert_idx::BIGINT AS pert_idx, rank, passage_idx, score FROM "


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "embeddings").select(F.col("vec_id").alias("passage_idx"), "embedding")


def clean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_idx"), F.lit(0).cast("bigint").alias("pert_idx"), "embedding"
    )


def perturbed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    table = given(spark, folder, "embeddings")
    n = table.count()
    asks = spread(table).select(
        F.col("vec_id").alias("query_idx"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot")
    ).withColumn("other", F.pmod(7 * F.col("query_idx") + 13 * (F.col("slot") + 1), F.lit(n)))
    others = table.select(F.col("vec_id").alias("other"), F.col("embedding").alias("_o"))
    moved = F.zip_with("embedding", "_o", lambda a, b: a.cast("double") + 0.5 * b.cast("double"))
    return (
        asks.join(others, "other")
        .withColumn("_m", moved)
        .select("query_idx", F.col("slot").cast("bigint").alias("pert_idx"),
                vectors.l2_normalise(F.col("_m")).alias("embedding"))
    )


def hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_idx", "pert_idx", F.col("rank").cast("bigint").alias("rank"), "passage_idx", "score")


def clean_hits(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return retrieval.top_k(clean_vectors(spark, folder), passages(spark, folder), k)


def perturbed_hits(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return retrieval.top_k(perturbed_vectors(spark, folder), passages(spark, folder), k)


@query("f1_perturbation_ordinals", with_ctes(
    "SELECT l_orderkey AS query_idx, slot AS slot_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY slot) - 1 AS pert_idx "
    "FROM slots", "slots AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS slot FROM lineitem)"))
def perturbation_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    rows = given(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_idx"), F.col("l_linenumber").cast("bigint").alias("slot_idx")
    ).distinct()
    return retrieval.pert_ordinals(rows).withColumn("pert_idx", F.col("pert_idx").cast("bigint"))


@query("f2_exact_top_k", with_ctes(HITS + "perturbed_top", *PERTURBED_TOP))
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return hit_columns(perturbed_hits(spark, folder))


@query("f2_exact_top_k_blocks", with_ctes(HITS + "perturbed_top", *PERTURBED_TOP))
def exact_top_k_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same without a broadcast, in blocks, as for query sets beyond the budget."""
    hits = retrieval.top_k(
        perturbed_vectors(spark, folder), passages(spark, folder), K,
        broadcast_bytes=0, query_block=1024, passage_block=256,
    )
    return hit_columns(hits)


def cells(spark: SparkSession, folder: str):
    return retrieval.fit_cells(passages(spark, folder), N_CELLS)


@query("f3_probed_all_cells", with_ctes(HITS + "perturbed_top", *PERTURBED_TOP))
def probed_all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """With as many probes as cells the probed search must equal the exact one."""
    hits = retrieval.probed_top_k(
        perturbed_vectors(spark, folder), passages(spark, folder), cells(spark, folder), K, probes=N_CELLS
    )
    return hit_columns(hits)


@query("f3_probed_recall")
def probed_recall(spark: SparkSession, folder: str) -> DataFrame:
    centres = cells(spark, folder)
    asked, held = settle(perturbed_vectors(spark, folder)), passages(spark, folder)
    exact = retrieval.top_k(asked, held, K)
    rows, found, before = None, None, 0
    for probes in (1, 4, N_CELLS):
        found, before = retrieval.probed_top_k(asked, held, centres, K, probes=probes, found=found, probed=before), probes
        one = retrieval.recall(found, exact).withColumn("probes", F.lit(probes))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def stored_index(spark: SparkSession, folder: str) -> str:
    """An index written from the passages with even ids; the others are appended without a new fit."""
    held, path = passages(spark, folder), scratch_path(spark, "cells")
    even = F.col("passage_idx") % 2 == 0
    cell_index.build(held.where(even), path, N_CELLS)
    cell_index.append(held.where(~even), path)
    return path


@query("f3_stored_index", with_ctes(HITS + "perturbed_top", *PERTURBED_TOP))
def stored_index_all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A search of all cells of an index written earlier equals the exact one."""
    return hit_columns(cell_index.search(perturbed_vectors(spark, folder), stored_index(spark, folder), K, probes=N_CELLS))


# From this many of 16 cells on, nine in ten of the exact hits are found.
ENOUGH = 12


@query("f3_stored_recall", with_ctes(
    f"SELECT probes, (SELECT count(*) FROM perturbed_top) AS n_exact, true AS not_falling, probes >= {ENOUGH} AS enough, "
    f"probes >= {N_CELLS} AS whole FROM (SELECT unnest([1, 4, {ENOUGH}, {N_CELLS}]) AS probes)", *PERTURBED_TOP))
def stored_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the stored index does not fall with the probes, reaches 0.9 at `ENOUGH` and 1 at all cells."""
    path, asked = stored_index(spark, folder), settle(perturbed_vectors(spark, folder))
    exact = retrieval.top_k(asked, passages(spark, folder), K)
    rows, before, hits, probed = [], 0.0, None, 0
    for probes in (1, 4, ENOUGH, N_CELLS):
        hits, probed = cell_index.search(asked, path, K, probes=probes, found=hits, probed=probed), probes
        found = retrieval.recall(hits, exact).first()
        rows.append((probes, found["n_exact"], found["recall"] >= before, probes >= ENOUGH and found["recall"] >= 0.9, found["recall"] == 1.0))
        before = found["recall"]
    return spark.createDataFrame(rows, "probes int, n_exact bigint, not_falling boolean, enough boolean, whole boolean")


# Texts exist only for the labelled documents, so some hits are missing.
TEXTS = "texts AS (SELECT doc_id AS passage_idx, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


def texts(spark: SparkSession, folder: str) -> DataFrame:
    labelled = given(spark, folder, "labels").select("doc_id").distinct()
    return given(spark, folder, "documents").join(labelled, "doc_id", "left_semi").select(
        F.col("doc_id").alias("passage_idx"), "text"
    )


@query("f4_f5_passage_texts", with_ctes(
    "SELECT query_idx, pert_idx::BIGINT AS pert_idx, rank, passage_idx, md5(text) AS text_md5 "
    "FROM perturbed_top JOIN texts USING (passage_idx)", *PERTURBED_TOP, TEXTS))
def passage_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The digest is taken once per passage, so no text travels to the hits."""
    hits = hit_columns(perturbed_hits(spark, folder))
    digests = texts(spark, folder).withColumn("text", F.md5("text"))
    return retrieval.with_text(hits, digests).select(
        "query_idx", "pert_idx", "rank", "passage_idx", F.col("text").alias("text_md5")
    )


ALL_TEXTS = "all_texts AS (SELECT doc_id AS passage_idx, text FROM documents)"


@query("f6_nested_candidates", with_ctes(
    "SELECT query_idx, pert_idx::BIGINT AS pert_idx, coalesce(candidates, '') AS candidates "
    "FROM (SELECT DISTINCT query_idx, pert_idx FROM perturbed) LEFT JOIN ("
    "SELECT query_idx, pert_idx, string_agg(rank || ':' || passage_idx, ',' ORDER BY rank) AS candidates "
    "FROM perturbed_top JOIN all_texts USING (passage_idx) GROUP BY ALL) USING (query_idx, pert_idx)",
    *PERTURBED_TOP, ALL_TEXTS))
def nested_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A record for every query, also for those whose hits have no text. Shown are ids alone, so texts are not carried."""
    all_texts = given(spark, folder, "documents").select(F.col("doc_id").alias("passage_idx"), "text")
    asked = settle(perturbed_vectors(spark, folder))
    hits = retrieval.with_text(hit_columns(retrieval.top_k(asked, passages(spark, folder), K)), all_texts).drop("text")
    shown = F.transform("candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["passage_idx"].cast("string")))
    records = retrieval.nest_hits(hits, queries=asked)
    return records.select("query_idx", "pert_idx", F.array_join(shown, ",").alias("candidates"))


@query("f7_two_query_texts", with_ctes(
    "SELECT c.query_idx, c.rank, c.passage_idx, c.score, round(list_dot_product(q.e, p.e), 6) AS scoring_score "
    "FROM clean_top c JOIN perturbed q ON q.query_idx = c.query_idx AND q.pert_idx = 0 JOIN passages p USING (passage_idx)",
    *CLEAN_TOP, MOVED))
def two_query_texts(spark: SparkSession, folder: str) -> DataFrame:
    hits = hit_columns(clean_hits(spark, folder))
    scored = retrieval.rescore(hits, perturbed_vectors(spark, folder), passages(spark, folder))
    return scored.select("query_idx", "rank", "passage_idx", "score", "scoring_score")


@query("f8_clean_retrieval", with_ctes(
    "SELECT query_idx, rank, passage_idx, score FROM clean_top", *CLEAN_TOP))
def clean_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return hit_columns(clean_hits(spark, folder)).drop("pert_idx")
