"""Training groups: one positive and N hard negatives per (query, rewrite)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LISTWISE_MODE
from ..functions.hashing import stable_hash
from ..functions.text import words
from .ordinal import dense_ordinal, ordinal_in_group
from .pool import LIST_PART

GROUP = ["query_idx", "pert_idx"]
CLS_ID, SEP_ID, PAD_ID, FIRST_WORD_ID = 1, 2, 0, 3


def positives(clean: DataFrame, scores: DataFrame) -> DataFrame:
    """Clean candidates with robustness above zero; copies stay. `clean` holds doc_key."""
    return clean.join(scores.select("query_idx", "doc_key", "robustness"), ["query_idx", "doc_key"]).where(
        F.col("robustness") > 0
    )


def hard_negatives(perturbed: DataFrame, scores: DataFrame) -> DataFrame:
    """Perturbed candidates, each document once per rewrite, with robustness zero."""
    first = Window.partitionBy(*GROUP, "doc_key").orderBy("rank", "score")
    once = perturbed.withColumn("_n", F.row_number().over(first)).where("_n <= 1").drop("_n")
    zero = scores.where(F.col("robustness") == 0).select("query_idx", "doc_key")
    return once.join(zero, ["query_idx", "doc_key"])


def eligibility(
    records: DataFrame, clean_queries: DataFrame, scores: DataFrame, pos: DataFrame, neg: DataFrame,
    n_neg: int = 10,
) -> DataFrame:
    """Each (query, rewrite) known to both inputs with its counts and its state.

    `state` is kept, no_positive or few_negatives. `records` is one row per rewrite.
    """
    scored = scores.select("query_idx").distinct()
    known = records.join(clean_queries.select("query_idx").distinct(), "query_idx", "left_semi").join(
        scored, "query_idx", "left_semi"
    )
    n_pos = pos.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n_pos"))
    n_negs = neg.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_neg"))
    counted = known.join(n_pos, "query_idx", "left").join(n_negs, GROUP, "left")
    zero = F.lit(0).cast("bigint")
    return counted.withColumns({
        "n_pos": F.coalesce("n_pos", zero), "n_neg": F.coalesce("n_neg", zero),
    }).withColumn(
        "state",
        F.when(F.col("n_pos") == 0, "no_positive").when(F.col("n_neg") < n_neg, "few_negatives").otherwise("kept"),
    )


def skip_counts(states: DataFrame) -> DataFrame:
    """One row: groups kept and groups skipped by reason."""
    return states.agg(
        F.count_if(F.col("state") == "kept").alias("n_groups"),
        F.count_if(F.col("state") == "no_positive").alias("n_skip_no_pos"),
        F.count_if(F.col("state") == "few_negatives").alias("n_skip_no_neg"),
    )


def draw_positive(
    states: DataFrame, pos: DataFrame, seed: int = 42, hot: list | None = None
) -> DataFrame:
    """One positive per kept group, drawn evenly.

    The positives of a query are numbered and each group picks a number, so groups and
    positives meet in an equi-join and no group is crossed with all positives.
    """
    numbered = ordinal_in_group(
        pos, ["query_idx"], [F.col("rank"), F.col("doc_key"), F.col("score")], "_pick", hot
    )
    picks = states.where(F.col("state") == "kept").select(
        *GROUP, F.pmod(stable_hash(seed, F.col("query_idx"), F.col("pert_idx")), F.col("n_pos")).alias("_pick")
    )
    found = picks.join(numbered.drop("pert_idx") if "pert_idx" in numbered.columns else numbered,
                       ["query_idx", "_pick"])
    return found.withColumn("doc_ord", F.lit(0)).drop("_pick")


def draw_negatives(states: DataFrame, neg: DataFrame, n_neg: int = 10, seed: int = 42) -> DataFrame:
    """`n_neg` negatives per kept group without replacement, in seeded order.

    The limit prunes each task's rows to n per group before they move; whether a group
    is kept is looked up only for those.
    """
    order = stable_hash(seed, F.col("query_idx"), F.col("pert_idx"), F.col("doc_key"))
    drawn = Window.partitionBy(*GROUP).orderBy("_h", "doc_key")
    few = neg.withColumn("_h", order).withColumn("doc_ord", F.row_number().over(drawn)).where(
        F.col("doc_ord") <= n_neg
    )
    kept = states.where(F.col("state") == "kept").select(*GROUP)
    return few.drop("_h").join(kept, GROUP, "left_semi")


def training_records(
    drawn_pos: DataFrame, drawn_neg: DataFrame, records: DataFrame, mode: str = LISTWISE_MODE
) -> DataFrame:
    """One row per document; `doc_ord` 0 is the positive.

    The question is the perturbed query, else the original, else the clean one. The
    stored score has four places; `robustness_raw` keeps the mean itself.
    """
    columns = [*GROUP, "doc_ord", "doc_key", "text", "score", "rank"]
    both = drawn_pos.select(*columns, F.col("robustness").alias("robustness_raw")).unionByName(
        drawn_neg.select(*columns, F.lit(0.0).alias("robustness_raw"))
    )

    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    question = F.coalesce(filled("perturbed_query"), filled("question"), F.col("clean_question"))
    asked = records.select(*GROUP, question.alias("_question"))
    return both.join(asked, GROUP).select(
        *GROUP, "doc_ord", "doc_key",
        F.col("_question").alias("question"),
        F.col("text").alias("document"),
        F.round("robustness_raw", 4).alias("robustness_score"),
        "robustness_raw",
        F.col("score").alias("retriever_score"),
        F.col("rank").alias("doc_rank"),
        F.lit(mode).alias("train_mode"),
    )


def group_key() -> Column:
    return F.concat_ws("_", F.col("query_idx"), F.coalesce(F.col("pert_idx"), F.lit(-1)))


NESTED_FIELDS = ("doc_ord", "text", "score", "doc_rank")


def nest_groups(records: DataFrame, part: int = LIST_PART, *, fields: tuple[str, ...] = NESTED_FIELDS) -> DataFrame:
    """One record per (query, rewrite) with its documents in `doc_ord` order.

    Groups from the drawing above hold 1 + N documents. A group with more than `part`
    goes on in records with part_no 1, 2, ... `doc_ord` must count from 0 in each group. Who needs few of a
    document's `fields` names them, `doc_ord` first, and the others do not move.
    """
    source = {"text": "document", "score": "robustness_score"}
    entry = F.struct(*[F.col(source.get(name, name)).alias(name) for name in fields])
    keyed = records.withColumn("key", group_key()).withColumn("part_no", F.floor(F.col("doc_ord") / part))
    return keyed.groupBy("key", "part_no").agg(
        F.min_by("question", "doc_ord").alias("question"),
        F.min_by("train_mode", "doc_ord").alias("train_mode"),
        F.array_sort(F.collect_list(entry)).alias("docs"),
    )


def ordered_records(records: DataFrame, order: list[Column]) -> DataFrame:
    """Adds `doc_ord` to records that come without one."""
    return ordinal_in_group(records, GROUP, order, "doc_ord")


def group_counts(records: DataFrame) -> DataFrame:
    """Documents, positives and zero-score documents per group."""
    score = F.col("robustness_score")
    return records.withColumn("key", group_key()).groupBy("key").agg(
        F.count_if(score > 0).alias("n_pos"),
        F.count_if(score == 0).alias("n_neg"),
        F.count(F.lit(1)).alias("n_docs"),
    )


def slice_groups(records: DataFrame, n_slices: int = 16) -> DataFrame:
    """(key, ordinal, slice, n_docs): groups dealt in turn over the slices, by (query, rewrite)."""
    per = records.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_docs"))
    numbered = dense_ordinal(per, [F.col("query_idx"), F.col("pert_idx")])
    return numbered.select(
        group_key().alias("key"), "ordinal", F.pmod(F.col("ordinal"), F.lit(n_slices)).alias("slice"), "n_docs"
    )


def manifest(slices: DataFrame, n_slices: int = 16) -> DataFrame:
    """Groups and records per slice, empty slices too, and a totals row (slice null)."""
    per = slices.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_docs").alias("n_records")
    )
    every = slices.sparkSession.range(n_slices).withColumnRenamed("id", "slice")
    zero = F.lit(0).cast("bigint")
    full = every.join(per, "slice", "left").withColumns(
        {"n_groups": F.coalesce("n_groups", zero), "n_records": F.coalesce("n_records", zero)}
    )
    return full.rollup("slice").agg(
        F.sum("n_groups").alias("n_groups"), F.sum("n_records").alias("n_records")
    )


def word_ids(text: Column, vocab: int = 32_000, limit: int | None = None) -> Column:
    """The built-in tokenizer: a hash id per word, from FIRST_WORD_ID up.

    `limit` leaves out words past the number that any encoding can keep.
    """
    tokens = words(F.lower(text))
    return F.transform(
        tokens if limit is None else F.slice(tokens, 1, limit),
        lambda w: (F.pmod(stable_hash(w), F.lit(vocab - FIRST_WORD_ID)) + FIRST_WORD_ID).cast("int"),
    )


def join_ids(question_ids: Column, doc_ids: Column, max_length: int = 512) -> Column:
    """[CLS] question [SEP] document [SEP], the longer side cut to fit."""
    room = max_length - 3
    half = room // 2
    q, d = F.size(question_ids), F.size(doc_ids)
    q_kept = (
        F.when(q + d <= room, q).when(q <= room - half, q).when(d <= half, room - d).otherwise(room - half)
    )
    d_kept = F.least(d, F.lit(room) - q_kept)
    return F.concat(
        F.array(F.lit(CLS_ID)), F.slice(question_ids, F.lit(1), q_kept), F.array(F.lit(SEP_ID)),
        F.slice(doc_ids, F.lit(1), d_kept), F.array(F.lit(SEP_ID)),
    )


def encode_records(
    records: DataFrame, max_length: int = 512, tokenize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds `input_ids`. `tokenize` maps a text column to an id array (a pandas UDF will do)."""
    ids = tokenize or (lambda text: word_ids(text, limit=max_length))
    tokens = records.withColumn("_q", ids(F.col("question"))).withColumn("_d", ids(F.col("document")))
    return tokens.withColumn("input_ids", join_ids(F.col("_q"), F.col("_d"), max_length)).drop("_q", "_d")


def encoded_groups(encoded: DataFrame, part: int = LIST_PART) -> DataFrame:
    """(key, part_no, train_mode, pos_mask, scores, input_ids) per group.

    Groups from the drawing hold 1 + N documents; longer ones go on in further parts.
    """
    entry = F.struct("doc_ord", F.col("robustness_score").alias("s"), F.col("input_ids").alias("ids"))
    keyed = encoded.withColumn("key", group_key()).withColumn("part_no", F.floor(F.col("doc_ord") / part))
    grouped = keyed.groupBy("key", "part_no").agg(
        F.min_by("train_mode", "doc_ord").alias("train_mode"),
        F.array_sort(F.collect_list(entry)).alias("_docs"),
    )
    return grouped.select(
        "key", "part_no", "train_mode",
        F.transform("_docs", lambda d: d["s"] > 0).alias("pos_mask"),
        F.transform("_docs", lambda d: d["s"].cast("float")).alias("scores"),
        F.transform("_docs", lambda d: d["ids"]).alias("input_ids"),
    )


def encoding_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, groups with a positive, pairs, mean sequence length.

    A group in several parts counts once.
    """
    lengths = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda acc, ids: acc + F.size(ids))
    per = groups.groupBy("key").agg(
        F.max(F.exists("pos_mask", lambda p: p)).alias("has_pos"),
        F.sum(F.size("pos_mask").cast("bigint")).alias("n"),
        F.sum(lengths).alias("length"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if("has_pos").alias("n_groups_with_pos"),
        F.sum("n").alias("n_pairs"),
        F.try_divide(F.sum("length"), F.sum("n")).alias("mean_length"),
    )


def group_range(groups: DataFrame, skip: int = 0, limit: int = 0) -> DataFrame:
    """Groups number skip, skip+1, ... in key order; `limit` 0 means all the rest.

    Only the keys are numbered; the groups meet those of the range in a join.
    """
    numbered = dense_ordinal(groups.select("key").distinct(), [F.col("key")])
    wanted = F.col("ordinal") >= skip
    if limit > 0:
        wanted = wanted & (F.col("ordinal") < skip + limit)
    return groups.join(numbered.where(wanted), "key")
