"""Rewrites: generation rounds, assembly, nesting, quality counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..session import settle
from .inference import BatchFn, apply_batches
from .queryset import prompt_text, topic_for

NESTED_FIELDS = [
    "slot_idx", "perturbation_type", "perturbation_text", "perturbed_query",
    "wrong_belief", "t2_variant", "topic",
]


def generate(
    tasks: DataFrame, generator: BatchFn, rounds: int = 5, seed: int = 42,
    reasoning: bool = False, concurrency: int | None = None, inputs: list[str] | None = None,
) -> DataFrame:
    """Asks the generator until a rewrite is valid, at most `rounds` times.

    Each round calls the model for the tasks still open, writes the answers once, and
    checks them with the Column rules; a retried distraction gets another topic. The
    result has `output` (null when every round failed), `attempt` and `is_fallback`. Only `inputs` (with `prompt`,
    `attempt` and `asked_topic` made here) go to the model; all columns if none are named.
    """
    clean = text.strip_reasoning_block if reasoning else text.clean_output
    open_tasks, done = tasks, []
    for attempt in range(rounds):
        topic = F.col("topic") if attempt == 0 else F.when(
            F.col("ptype") == 3, topic_for(seed, F.col("query_idx"), F.col("slot_idx"), attempt)
        )
        asked = open_tasks.withColumn("attempt", F.lit(attempt)).withColumn("asked_topic", topic).withColumn(
            "prompt", prompts.messages(prompts.REWRITE_SYSTEM, prompt_text(F.col("asked_topic")))
        )
        answered = apply_batches(asked, generator, "raw", concurrency=concurrency, inputs=inputs)
        checked = answered.withColumn("output", clean(F.coalesce("raw", F.lit("")))).withColumn(
            "_ok",
            text.is_valid_rewrite(
                F.col("output"), F.col("ptype"), F.col("question"), F.col("wa"), F.col("all_answers")
            ),
        )
        kept = settle(checked.drop("prompt", "raw", "asked_topic"))
        done.append(kept.where("_ok").drop("_ok").withColumn("is_fallback", F.lit(False)))
        open_tasks = kept.where(~F.col("_ok")).drop("_ok", "output", "attempt")
        if open_tasks.isEmpty():
            break
    else:
        given_up = open_tasks.withColumn("attempt", F.lit(rounds)).withColumn(
            "output", F.lit(None).cast("string")
        )
        done.append(given_up.withColumn("is_fallback", F.lit(True)))
    return reduce(DataFrame.unionByName, done)


def assemble(rows: DataFrame, note_prefix: str | None = None, end_mark: bool = True) -> DataFrame:
    """The perturbed query of each slot, with the fields of its type.

    An empty output falls back to the question. `end_mark` closes types 1 and 2 with a
    question mark and makes that sentence the rewrite text; `note_prefix` stands between
    the question and a distraction. `is_fallback` says that the generator gave up (false where
    the rows do not say).
    """
    out = F.coalesce("output", F.lit(""))
    question, ptype = F.col("question"), F.col("ptype")
    note = F.lit(f" {note_prefix} " if note_prefix else " ")
    sentence = F.when(out != "", text.strip(out) if end_mark else out).otherwise(question)
    if end_mark:
        closed = (sentence == "") | sentence.rlike(r"[?.!]\z")
        sentence = F.when(closed, sentence).otherwise(F.concat(sentence, F.lit("?")))
    distracted = F.when(out != "", F.concat(question, note, out)).otherwise(question)
    return rows.select(
        "query_idx", "slot_idx", "question", "correct_answer", "all_answers",
        ptype.alias("perturbation_type"),
        F.when(ptype == 3, out).otherwise(sentence if end_mark else out).alias("perturbation_text"),
        F.when(ptype == 3, distracted).otherwise(sentence).alias("perturbed_query"),
        F.when(ptype == 1, F.col("wa")).alias("wrong_belief"),
        F.when(ptype == 2, F.col("t2_variant")).alias("t2_variant"),
        F.when(ptype == 3, F.col("topic")).alias("topic"),
        (out == "").alias("is_empty"),
        (F.coalesce("is_fallback", F.lit(False)) if "is_fallback" in rows.columns else F.lit(False)).alias("is_fallback"),
    )


def filtered(rows: DataFrame) -> DataFrame:
    """The rewrites that pass the composite check."""
    return rows.where(
        text.is_valid_rewrite(
            F.col("output"), F.col("ptype"), F.col("question"), F.col("wa"), F.col("all_answers")
        )
    )


def nest(flat: DataFrame) -> DataFrame:
    """One record per query with its slots in order.

    A slot counts once (its smallest row), so a list holds at most as many entries as
    the plan has slots, however often a row was delivered.
    """
    entry = F.struct(*NESTED_FIELDS)
    head = F.struct("question", "correct_answer", "all_answers")
    once = flat.groupBy("query_idx", "slot_idx").agg(F.min(entry).alias("_e"), F.min(head).alias("_h"))
    return once.groupBy("query_idx").agg(
        F.min("_h").alias("_h"), F.array_sort(F.collect_list("_e")).alias("perturbations")
    ).select("query_idx", "_h.*", "perturbations")


def flatten(nested: DataFrame) -> DataFrame:
    """One row per rewrite; `pert_idx` is its place in the list."""
    return nested.select(
        "query_idx", "question", "correct_answer", "all_answers",
        F.posexplode("perturbations").alias("pert_idx", "_e"),
    ).select("query_idx", "question", "correct_answer", "all_answers", "pert_idx", "_e.*")


def quality(flat: DataFrame) -> DataFrame:
    """One row of counters: leaks among rows that can show one, fallbacks, empties."""
    answer, question = F.col("correct_answer"), F.col("question")
    testable = (F.length(answer) > 3) & ~F.contains(F.lower(question), F.lower(answer))
    leaked = testable & text.mentions_word(F.col("perturbation_text"), answer)
    return flat.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(testable).alias("n_testable"),
        F.count_if(leaked).alias("n_leaks"),
        F.count_if(F.col("is_empty")).alias("n_empty"),
        F.count_if(F.col("is_fallback")).alias("n_fallback"),
        F.count_if(F.col("perturbed_query") == question).alias("n_as_question"),
    )


def balanced_pick() -> Column:
    """The first rewrite of type 1 + query_idx % 3, else the first, else the question."""
    wanted = 1 + F.pmod(F.col("query_idx"), F.lit(3))
    of_type = F.filter("perturbations", lambda p: p["perturbation_type"] == wanted)
    entry = F.coalesce(F.get(of_type, 0), F.get("perturbations", 0))
    return F.coalesce(entry["perturbed_query"], F.col("question"))


def test_queries(nested: DataFrame) -> DataFrame:
    return nested.select("query_idx", "all_answers", balanced_pick().alias("query"))
