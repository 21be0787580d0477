"""Candidate pools: union of clean and perturbed hits, deduplicated per query.

Candidates are flat rows (query_idx, pert_idx, rank, passage_idx, idx, text, score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import doc_key
from .ordinal import ordinal_in_group
from .skew import HotKeys, hot_keys, split_hot_join

# Longest candidate list in one nested record. Longer pools go on in further records.
LIST_PART = 10_000
# Caps up to this size are pruned per task before the shuffle.
PRUNED_CAP = 1_000


def with_key(candidates: DataFrame) -> DataFrame:
    """Adds `doc_key`; merges the two id columns; a missing score counts as 0."""
    return candidates.select(
        *[c for c in candidates.columns if c not in ("passage_idx", "idx", "score")],
        F.coalesce("passage_idx", "idx").alias("passage_idx"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        doc_key(F.col("passage_idx"), F.col("idx"), F.col("text")).alias("doc_key"),
    )


def last_record(records: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of several records with the same key the last one."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return records.withColumn("_n", F.row_number().over(latest)).where("_n <= 1").drop("_n")


def known_only(perturbed: DataFrame, queries: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Perturbed rows of queries that the clean side knows."""
    return split_hot_join(
        perturbed, queries.select("query_idx").distinct(), ["query_idx"], "query_idx", "left_semi", hot=hot
    )


def union_candidates(clean: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Clean rows first (`src` 0, no pert_idx), then perturbed ones."""
    first = clean.withColumn("src", F.lit(0)).withColumn("pert_idx", F.lit(-1).cast("int"))
    second = perturbed.withColumn("src", F.lit(1)).withColumn("pert_idx", F.col("pert_idx").cast("int"))
    return first.unionByName(second)


def first_occurrence(candidates: DataFrame) -> DataFrame:
    """One row per (query, document), the first in (src, pert_idx, rank) order.

    The row limit of one is applied per task before the shuffle, so copies of a
    document do not travel.
    """
    earliest = Window.partitionBy("query_idx", "doc_key").orderBy("src", "pert_idx", "rank", "score")
    return candidates.withColumn("_n", F.row_number().over(earliest)).where("_n <= 1").drop("_n")


def build_pool(
    clean: DataFrame, perturbed: DataFrame, queries: DataFrame, max_per_query: int = 0,
    hot: HotKeys | None = None,
) -> DataFrame:
    """(query_idx, pool_rank, doc_key, passage_idx, text, score, src, pert_idx, rank).

    `pool_rank` counts from 0 in first-occurrence order. A cap keeps the first
    `max_per_query` documents; 0 keeps all.
    """
    known = known_only(perturbed, queries, hot)
    once = first_occurrence(with_key(union_candidates(clean, known)))
    order = ["src", "pert_idx", "rank", "doc_key"]
    if 0 < max_per_query <= PRUNED_CAP:
        place = Window.partitionBy("query_idx").orderBy(*order)
        ranked = once.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= max_per_query)
        return ranked.withColumn("pool_rank", (F.col("_n") - 1).cast("bigint")).drop("_n")
    ranked = ordinal_in_group(once, ["query_idx"], [F.col(c) for c in order], "pool_rank", hot)
    return ranked.where(F.col("pool_rank") < max_per_query) if max_per_query > 0 else ranked


def nest_pool(queries: DataFrame, pool: DataFrame, part: int = LIST_PART) -> DataFrame:
    """One record per query with its candidates in pool order; empty pools stay.

    A pool longer than `part` continues in records with part_no 1, 2, ...
    """
    entry = F.struct("pool_rank", "passage_idx", "text", "score")
    lists = (
        pool.withColumn("part_no", F.floor(F.col("pool_rank") / part))
        .groupBy("query_idx", "part_no")
        .agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    )
    joined = queries.join(lists, "query_idx", "left")
    return joined.select(
        "query_idx", "question",
        F.coalesce("correct_answer", F.lit("")).alias("correct_answer"),
        F.coalesce("all_answers", F.array().cast("array<string>")).alias("all_answers"),
        F.coalesce("part_no", F.lit(0)).alias("part_no"),
        F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)).alias("candidates"),
    )


def hot_queries(candidates: DataFrame) -> HotKeys:
    """Queries that hold a large share of the candidates."""
    return hot_keys(candidates, "query_idx")
