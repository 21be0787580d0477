"""Query sets: canonical answers, wrong beliefs, slots, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.fixed import MISSING_AVOID, SLOT_PATTERNS, TOPICS, UNKNOWN_BELIEF
from ..functions.hashing import stable_hash
from ..functions.text import entity_like
from .ordinal import dense_ordinal
from .skew import split_hot_join

# Up to this many rows a cap is a top-n; above it rows are numbered across the cluster.
TOP_N_ROWS = 100_000


def answered(raw: DataFrame) -> DataFrame:
    """Queries with an answer; the first answer is the canonical one. Ids stay as they are."""
    return raw.where(F.size("answers") > 0).select(
        "query_idx", "question",
        F.element_at("answers", 1).alias("correct_answer"),
        F.col("answers").alias("all_answers"),
    )


def shuffled_cap(queries: DataFrame, cap: int = 10_000, seed: int = 42) -> DataFrame:
    """`cap` queries in seeded order, with new ids 0, 1, 2, ... in that order."""
    order = [stable_hash(seed, F.col("query_idx")), F.col("query_idx")]
    kept = queries.orderBy(*order).limit(cap) if cap <= TOP_N_ROWS else queries
    numbered = dense_ordinal(kept.withColumnRenamed("query_idx", "source_idx"),
                             [stable_hash(seed, F.col("source_idx")), F.col("source_idx")], "query_idx")
    return numbered.where(F.col("query_idx") < cap)


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    return queries.orderBy("query_idx").limit(n)


def with_datasets(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.col("dataset").isin(names))


def belief_pool(queries: DataFrame) -> DataFrame:
    """Distinct canonical answers that look like names."""
    return queries.where(entity_like(F.col("correct_answer"))).select(
        F.col("correct_answer").alias("belief")
    ).distinct()


def sample_beliefs(
    queries: DataFrame, pool: DataFrame, k: int = 2, seed: int = 42, pad: bool = True
) -> DataFrame:
    """Adds `beliefs`: k pool entries per query, drawn evenly without replacement.

    A query's own answer is left out in any case. The pool is numbered in lower-case
    order, so the entries equal to an answer are one run of numbers: drawing from the
    others is drawing a number below (size - run) and stepping over the run. Each draw
    also steps over the ones before it. Nothing is rejected and no pair is built; the
    drawn numbers meet the pool in an equi-join.

    With `pad`, missing draws become "Unknown"; else the list is only as long as the
    pool allows, and holds "Unknown" alone when it would be empty.
    """
    numbered = dense_ordinal(
        pool.withColumn("_low", F.lower("belief")), [F.col("_low"), F.col("belief")], "_pos"
    )
    size = numbered.count()
    own = numbered.groupBy("_low").agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_run"))
    base = queries.withColumn("_low", F.lower("correct_answer"))
    drawn = (
        split_hot_join(base, own, ["_low"], "_low", "left")
        .withColumn("_run", F.coalesce("_run", F.lit(0)))
        .withColumn("_free", F.lit(size) - F.col("_run"))
    )
    names: list[str] = []
    for j in range(k):
        raw = F.when(
            F.col("_free") > j,
            F.pmod(stable_hash(seed, F.col("query_idx"), j), F.greatest(F.col("_free") - j, F.lit(1))),
        )
        if names:
            before = F.array_sort(F.array(*names))
            raw = F.aggregate(before, raw, lambda at, p: at + F.when(at >= p, 1).otherwise(0))
        drawn = drawn.withColumn(f"_d{j}", raw)
        names.append(f"_d{j}")
    step = F.when(F.col("_from").isNotNull(), F.col("_from"))

    def place(name: str) -> Column:
        return F.col(name) + F.when(F.col(name) >= step, F.col("_run")).otherwise(0)

    picks = F.array(*[F.struct(F.lit(j).alias("j"), place(n).alias("pos")) for j, n in enumerate(names)])
    rows = drawn.select("query_idx", F.explode(picks).alias("_p")).select("query_idx", "_p.j", "_p.pos")
    # Draws that the pool is too small for have no number; they do not meet in a join.
    drawn_ones = rows.where("pos IS NOT NULL").join(numbered.select(F.col("_pos").alias("pos"), "belief"), "pos", "left")
    found = drawn_ones.unionByName(rows.where("pos IS NULL").withColumn("belief", F.lit(None).cast("string")))
    lists = found.groupBy("query_idx").agg(
        F.array_sort(F.collect_list(F.struct("j", "belief"))).alias("_all")  # k entries
    )
    if pad:
        beliefs = F.transform("_all", lambda p: F.coalesce(p["belief"], F.lit(UNKNOWN_BELIEF)))
    else:
        beliefs = F.transform(F.filter("_all", lambda p: p["belief"].isNotNull()), lambda p: p["belief"])
        beliefs = F.when(F.size(beliefs) > 0, beliefs).otherwise(F.array(F.lit(UNKNOWN_BELIEF)))
    return queries.join(lists.select("query_idx", beliefs.alias("beliefs")), "query_idx")


def plan_slots(queries: DataFrame) -> DataFrame:
    """Five slots per query; the pattern turns with the id so types are 1:1:1 overall.

    `nth` counts a slot's type inside its query and comes from the pattern itself.
    """
    patterns = F.array(*[F.array(*[F.lit(t) for t in p]) for p in SLOT_PATTERNS])
    planned = queries.withColumn("_pattern", F.get(patterns, F.pmod(F.col("query_idx"), F.lit(3)).cast("int")))
    slots = planned.select("*", F.posexplode("_pattern").alias("slot_idx", "ptype"))
    so_far = F.filter(
        F.slice("_pattern", F.lit(1), F.col("slot_idx") + 1), lambda t: t == F.col("ptype")
    )
    return slots.withColumn("nth", F.size(so_far) - 1).drop("_pattern")


def topic_for(*seed_parts) -> Column:
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return F.get(topics, F.pmod(stable_hash(*seed_parts), F.lit(len(TOPICS))).cast("int"))


def slot_tasks(queries: DataFrame, seed: int = 42) -> DataFrame:
    """Tasks with the words their type needs. `queries` holds `beliefs`."""
    slots = plan_slots(queries)
    at = F.pmod(F.col("nth"), F.size("beliefs")).cast("int")
    return slots.select(
        "query_idx", "slot_idx", "ptype", "question", "correct_answer", "all_answers",
        F.when(F.col("ptype") == 1, F.get("beliefs", at)).alias("wa"),
        F.when(
            F.col("ptype") == 2, F.when(F.pmod(F.col("nth"), F.lit(2)) == 0, "A").otherwise("B")
        ).alias("t2_variant"),
        F.when(F.col("ptype") == 3, topic_for(seed, F.col("query_idx"), F.col("slot_idx"))).alias("topic"),
    )


def prompt_text(
    topic: Column | None = None, templates: dict[str, str] | None = None, mark_missing: bool = False
) -> Column:
    """The user message of a task. `mark_missing` writes <unknown> for an empty answer."""
    texts = templates or prompts.REWRITE_TEMPLATES
    avoid = F.col("correct_answer")
    if mark_missing:
        avoid = F.when(F.coalesce(avoid, F.lit("")) != "", avoid).otherwise(F.lit(MISSING_AVOID))
    values = {
        "q": F.col("question"), "avoid": avoid, "wa": F.col("wa"),
        "topic": F.col("topic") if topic is None else topic,
    }
    return (
        F.when(F.col("ptype") == 1, prompts.fill(texts["1"], **values))
        .when((F.col("ptype") == 2) & (F.col("t2_variant") == "A"), prompts.fill(texts["2A"], **values))
        .when(F.col("ptype") == 2, prompts.fill(texts["2B"], **values))
        .otherwise(prompts.fill(texts["3"], **values))
    )


def with_prompts(tasks: DataFrame, templates: dict[str, str] | None = None,
                 mark_missing: bool = False) -> DataFrame:
    user = prompt_text(None, templates, mark_missing)
    return tasks.withColumn("prompt", prompts.messages(prompts.REWRITE_SYSTEM, user))
