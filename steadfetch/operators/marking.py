"""Marking: does a passage let the teacher answer a rewrite; robustness from the marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions.fixed import (
    CONTEXT_CHARS, JUDGE_MESSAGE, MAX_GOLDS, PREDICTION_CHARS, QUESTION_CHARS, TEACHER_MESSAGE,
)
from ..session import settle
from .inference import BatchFn, apply_batches
from .skew import HotKeys, split_hot_join

PAIR_KEYS = ["query_idx", "pert_idx", "doc_rank"]


def expand_pairs(pool: DataFrame, perts: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Every (rewrite, pooled document) pair of a query. `doc_rank` is the pool position."""
    docs = pool.withColumnRenamed("pool_rank", "doc_rank")
    return split_hot_join(docs, perts, ["query_idx"], "query_idx", hot=hot)


def pair_count(pool: DataFrame, perts: DataFrame) -> DataFrame:
    """One row: how many pairs there will be, from counts alone."""
    docs = pool.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n_docs"))
    asks = perts.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n_perts"))
    return docs.join(asks, "query_idx").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_perts")), F.lit(0)).alias("n_pairs"),
    )


def teacher_user(context: Column, question: Column) -> Column:
    return prompts.fill(
        TEACHER_MESSAGE, ctx=F.substring(context, 1, CONTEXT_CHARS), q=F.substring(question, 1, QUESTION_CHARS)
    )


def judge_user(question: Column, golds: Column, prediction: Column) -> Column:
    shown = F.when(F.coalesce(prediction, F.lit("")) != "", prediction).otherwise(F.lit("unknown"))
    return prompts.fill(
        JUDGE_MESSAGE,
        q=F.substring(question, 1, QUESTION_CHARS),
        golds=F.array_join(F.slice(golds, 1, MAX_GOLDS), " | "),
        pred=F.substring(shown, 1, PREDICTION_CHARS),
    )


def lexical_answer(context: Column, golds: Column) -> Column:
    """The built-in teacher: the first gold that the context holds, else `unknown`."""
    low = F.lower(context)
    return F.coalesce(F.get(F.filter(golds, lambda g: F.contains(low, F.lower(g))), 0), F.lit("unknown"))


def lexical_verdict(prediction: Column, golds: Column) -> Column:
    """The built-in judge."""
    return F.when(text.answer_matches(prediction, golds), "yes").otherwise("no")


def mark(pairs: DataFrame, teacher: BatchFn | None = None, judge: BatchFn | None = None) -> DataFrame:
    """Adds pred, judge_raw and correct. `pairs` holds perturbed_query, text and golds.

    Answers that match a gold exactly skip the judge. Model answers are written once
    before they are used twice; the judge sees only the rows that need it.
    """
    if teacher is None:
        answered = pairs.withColumn("pred", lexical_answer(F.col("text"), F.col("golds")))
    else:
        asked = pairs.withColumn(
            "prompt", prompts.messages(prompts.TEACHER_SYSTEM, teacher_user(F.col("text"), F.col("perturbed_query")))
        )
        raw = apply_batches(asked, teacher, "_raw", inputs=["prompt", "perturbed_query", "text", "golds"]).withColumn("pred", text.strip(F.coalesce("_raw", F.lit(""))))
        answered = settle(raw.drop("prompt", "_raw"))
    matched = answered.withColumn("_em", text.exact_match_any(F.col("pred"), F.col("golds")))
    if judge is None:
        verdict = F.when(F.col("_em"), "yes (em)").otherwise(lexical_verdict(F.col("pred"), F.col("golds")))
        judged = matched.withColumn("judge_raw", verdict)
    else:
        sure = matched.where("_em").withColumn("judge_raw", F.lit("yes (em)"))
        asked = matched.where(~F.col("_em")).withColumn(
            "prompt",
            prompts.messages(
                prompts.JUDGE_SYSTEM, judge_user(F.col("perturbed_query"), F.col("golds"), F.col("pred"))
            ),
        )
        said = apply_batches(asked, judge, "_raw", inputs=["prompt", "perturbed_query", "golds", "pred"]).withColumn("judge_raw", F.lower(text.strip(F.coalesce("_raw", F.lit("")))))
        judged = sure.unionByName(settle(said.drop("prompt", "_raw")))
    return judged.withColumn("correct", F.startswith(F.col("judge_raw"), F.lit("yes"))).drop("_em")


def verdict_rows(marked: DataFrame) -> DataFrame:
    """The columns a verdict is stored with."""
    return marked.select(
        "query_idx", "doc_rank", "pert_idx", "pert_type", "pred", "judge_raw", "correct",
        F.col("score").alias("doc_score"), "passage_idx",
        F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("doc_text_hash"),
    )


def resolve_keys(verdicts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Verdicts with their `doc_key`: by passage id, else text hash, else list position.

    `ranked` is the list that was marked (query_idx, rank, doc_key). Only verdicts with
    neither id nor hash are looked up; those without a match drop out.
    """
    has_hash = F.coalesce("doc_text_hash", F.lit("")) != ""
    direct = F.coalesce(
        F.concat(F.lit("pid:"), F.col("passage_idx").cast("string")),
        F.when(has_hash, F.concat(F.lit("sha1:"), F.col("doc_text_hash"))),
    )
    keyed = verdicts.withColumn("doc_key", direct)
    named = keyed.where(F.col("doc_key").isNotNull())
    by_place = ranked.select("query_idx", F.col("rank").alias("doc_rank"), "doc_key")
    looked_up = keyed.where(F.col("doc_key").isNull()).drop("doc_key").join(by_place, ["query_idx", "doc_rank"])
    return named.unionByName(looked_up)


def robustness(keyed: DataFrame) -> DataFrame:
    """Mean mark per (query, document). Counts combine per task before the shuffle."""
    return keyed.groupBy("query_idx", "doc_key").agg(
        F.count(F.lit(1)).alias("n_marks"),
        F.count_if(F.col("correct")).alias("n_correct"),
    ).withColumn("robustness", F.col("n_correct") / F.col("n_marks"))

