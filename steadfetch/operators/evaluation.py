"""Evaluation: rerank, gate, answer, calibrate.

Metrics depend on a result only through (confidence, correct), so each (dataset, method)
is first tallied: rows and correct rows per distinct confidence. All figures come from
the tally. No list of a method's results is ever held in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions.fixed import ABSTAIN_TEXT, ANSWER_MESSAGE, EVIDENCE_CHARS
from ..session import settle
from .inference import BatchFn, apply_batches
from .ordinal import running_start
from .skew import join_group_stats

BY = ["dataset", "method"]
QUERY = BY + ["query_id"]


def depth_cut(ranked: DataFrame, depth: int = 100) -> DataFrame:
    """Only the first `depth` candidates go to the critic."""
    return ranked.where(F.col("rank") < depth)


def retrieval_ranks(scored: DataFrame, order: list[Column], depth: int = 100) -> DataFrame:
    """Ranks of the first `depth` candidates per query; tasks prune before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*QUERY).orderBy(*order))
    return scored.withColumn("_n", place).where(F.col("_n") <= depth).withColumn(
        "rank", F.col("_n") - 1
    ).drop("_n")


def rerank(scored: DataFrame) -> DataFrame:
    """Adds `new_rank` by critic score; equal scores keep their retrieval order.

    Lists are at most as long as the depth cut left them.
    """
    order = Window.partitionBy(*QUERY).orderBy(F.desc("rerank_score"), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order) - 1)


def contexts(
    queries: DataFrame, ranked: DataFrame, gamma: float | None = None, max_docs: int = 3
) -> DataFrame:
    """One row per query: context documents, abstained or not, raw confidence.

    `ranked` holds new_rank, text, score and rerank_score (null where the method has no
    critic). The gate looks at the best document; the documents after it count while
    they reach gamma. A query without documents does not abstain.
    """
    entry = F.struct("new_rank", "rerank_score", "score", "text")
    tops = ranked.where(F.col("new_rank") < max_docs).groupBy(*QUERY).agg(
        F.array_sort(F.collect_list(entry)).alias("_docs")  # max_docs entries
    )
    best = F.get("_docs", 0)
    gated = queries.join(tops, QUERY, "left").withColumn(
        "confidence", F.coalesce(best["rerank_score"], best["score"], F.lit(0.0))
    )
    if gamma is None:
        abstained, docs = F.lit(False), F.col("_docs")
    else:
        abstained = F.coalesce(best["rerank_score"] < gamma, F.lit(False))
        by_gate = F.filter("_docs", lambda d: d["rerank_score"] >= gamma)
        docs = F.when(best["rerank_score"].isNull(), F.col("_docs")).otherwise(by_gate)
    kept = F.when(abstained, F.array().cast("array<string>")).otherwise(
        F.coalesce(F.transform(docs, lambda d: d["text"]), F.array().cast("array<string>"))
    )
    return gated.withColumn("abstained", abstained).withColumn("context", kept).drop("_docs")


def evidence(context: Column) -> Column:
    """The context documents, each cut at its character limit, with blank lines between."""
    return F.array_join(F.transform(context, lambda t: F.substring(t, 1, EVIDENCE_CHARS)), "\n\n")


def lexical_reply(context: Column, golds: Column) -> Column:
    """The built-in generator: the first gold found in the evidence."""
    low = F.lower(evidence(context))
    return F.coalesce(F.get(F.filter(golds, lambda g: F.contains(low, F.lower(g))), 0), F.lit("unknown"))


def answer(
    gated: DataFrame, generator: BatchFn | None = None, concurrency: int | None = None, inputs: list[str] | None = None
) -> DataFrame:
    """Adds `answer`. Only queries that do not abstain reach the generator, and of them `inputs` (or all columns)."""
    if generator is None:
        said = lexical_reply(F.col("context"), F.col("golds"))
        return gated.withColumn("answer", F.when(F.col("abstained"), ABSTAIN_TEXT).otherwise(said))
    # A critic that is not exactly repeatable must not put a query on both sides, or on neither.
    gated = settle(gated)
    quiet = gated.where("abstained").withColumn("answer", F.lit(ABSTAIN_TEXT))
    user = prompts.fill(ANSWER_MESSAGE, evidence=evidence(F.col("context")), q=F.col("query"))
    asked = gated.where(~F.col("abstained")).withColumn(
        "prompt", prompts.messages(prompts.ANSWER_SYSTEM, user)
    )
    raw = apply_batches(asked, generator, "_raw", concurrency=concurrency, inputs=inputs)
    said = raw.withColumn("answer", text.salvage_answer(F.col("_raw"))).drop("prompt", "_raw")
    return settle(said).unionByName(quiet)


def judged(answered: DataFrame) -> DataFrame:
    """Adds `correct`: the answer matches a gold. Abstain texts are matched like any other."""
    return answered.withColumn("correct", text.answer_matches(F.col("answer"), F.col("golds")))


def tally(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, confidence, n, hits): results per distinct confidence, written once."""
    return settle(
        results.groupBy(*(by or BY), "confidence").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("hits")
        )
    )


def normalised(tallied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confidences as they are when all lie in [0, 1]; else min-max scaled; 0.5 when constant."""
    by = by or BY
    bounds = tallied.groupBy(*by).agg(F.min("confidence").alias("_lo"), F.max("confidence").alias("_hi"))
    c, lo, hi = F.col("confidence"), F.col("_lo"), F.col("_hi")
    scaled = F.when((lo >= 0) & (hi <= 1), c).when(hi > lo, F.try_divide(c - lo, hi - lo)).otherwise(F.lit(0.5))
    wide = join_group_stats(tallied, bounds, by)
    return wide.withColumn("raw_confidence", c).withColumn("confidence", scaled).drop("_lo", "_hi")


def _bin(confidence: Column, edges: list[float]) -> Column:
    """Index of the highest edge not above the value; -1 below all."""
    steps = [F.when(confidence >= F.lit(e), 1).otherwise(0) for e in edges]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total - 1


def calibration_bins(
    tallied: DataFrame, by: list[str] | None = None, n_bins: int = 10, include_right: bool = False
) -> DataFrame:
    """Rows per (by, bin): count, accuracy, mean confidence, gap. Bins are half-open.

    Values outside all bins have bin null; a confidence of exactly 1 is one of them
    unless `include_right` counts it to the last bin.
    """
    at = _bin(F.col("confidence"), [i * (1 / n_bins) for i in range(n_bins)] + [1.0])
    if include_right:
        at = F.when(F.col("confidence") == 1.0, n_bins - 1).otherwise(at)
    inside = F.when(at.between(0, n_bins - 1), at)
    counted = tallied.withColumn("bin", inside).groupBy(*(by or BY), "bin").agg(
        F.sum("n").alias("n"),
        F.sum("hits").alias("_h"),
        F.sum(F.col("confidence") * F.col("n")).alias("_c"),
    )
    return counted.select(
        *(by or BY), "bin", "n",
        (F.col("_h") / F.col("n")).alias("accuracy"),
        (F.col("_c") / F.col("n")).alias("mean_confidence"),
    ).withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def calibration_error(
    tallied: DataFrame, by: list[str] | None = None, n_bins: int = 10, include_right: bool = False
) -> DataFrame:
    """ECE and MCE per group. Rows in no bin stay in the denominator."""
    bins = calibration_bins(tallied, by, n_bins, include_right)
    gap = F.when(F.col("bin").isNotNull(), F.col("gap"))
    zero = F.lit(0.0)
    return bins.groupBy(*(by or BY)).agg(
        F.coalesce(F.sum(gap * F.col("n")) / F.sum("n"), zero).alias("ece"),
        F.coalesce(F.max(gap), zero).alias("mce"),
    )


def accuracy(tallied: DataFrame, by: list[str] | None = None) -> DataFrame:
    return tallied.groupBy(*(by or BY)).agg(
        F.sum("n").alias("n_examples"), (F.sum("hits") / F.sum("n")).alias("accuracy")
    )


def _correlation(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Correlation of `_x` (weighted by n, centred) with the correct flag; null if either is constant."""
    sums = rows.groupBy(*by).agg(
        F.sum("n").alias("_n"), F.sum("hits").alias("_h"),
        F.sum(F.col("n") * F.col("_x")).alias("_sx"),
        F.sum(F.col("n") * F.col("_x") * F.col("_x")).alias("_sxx"),
        F.sum(F.col("hits") * F.col("_x")).alias("_sxy"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
    )
    n, h = F.col("_n"), F.col("_h")
    xx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / n
    yy = h - h * h / n
    xy = F.col("_sxy") - F.col("_sx") * h / n
    varies = (F.col("_lo") < F.col("_hi")) & (h > 0) & (h < n)
    return sums.select(*by, F.when(varies, F.try_divide(xy, F.sqrt(F.greatest(xx * yy, F.lit(0.0))))).alias(name))


def pearson(tallied: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or BY
    means = tallied.groupBy(*by).agg((F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("_mean"))
    centred = join_group_stats(tallied, means, by).withColumn("_x", F.col("confidence") - F.col("_mean"))
    return _correlation(centred, by, "pearson_r")


def spearman(tallied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks.

    A confidence's average rank follows from the number of rows below it, a running sum
    of counts over the ordered tally. The ranks of a 0/1 column are a straight line in
    it, so the flag itself serves.
    """
    by = by or BY
    # A confidence may occur in several rows after scaling; ranks need it once.
    merged = tallied.groupBy(*by, "confidence").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    placed = running_start(merged, [F.col(c) for c in by] + [F.col("confidence")], F.col("n"), "_below")
    base = placed.groupBy(*by).agg(F.min("_below").alias("_base"), F.sum("n").alias("_total"))
    mid = F.col("_below") - F.col("_base") + (F.col("n") + 1) / 2
    centred = join_group_stats(placed, base, by).withColumn("_x", mid - (F.col("_total") + 1) / 2)
    return _correlation(centred, by, "spearman_rho")


def risk_coverage(tallied: DataFrame, by: list[str] | None = None, points: int = 100) -> DataFrame:
    """Coverage and accuracy at evenly spaced thresholds from 0 to 1.

    Rows fall to the highest threshold they reach, which leaves at most points + 1 rows
    per group; the curve adds them up from the top.
    """
    by = by or BY
    step = 1 / (points - 1)
    c = F.col("confidence")
    guess = F.least(F.greatest(F.floor(c * (points - 1)) + 1, F.lit(-1)), F.lit(points - 1))
    # The product may round past an edge by one place; step down while the edge is above.
    for _ in range(2):
        guess = F.when((guess >= 0) & (guess * F.lit(step) > c), guess - 1).otherwise(guess)
    counted = tallied.withColumn("_at", guess).groupBy(*by, "_at").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits")
    )
    lists = counted.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("_at").alias("at"), "n", "hits")).alias("_c"), F.sum("n").alias("_total")
    )
    curve = lists.select(*by, "_c", "_total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))

    def above(field: str) -> Column:
        kept = F.filter("_c", lambda b: b["at"] >= F.col("point"))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, b: acc + b[field])

    summed = curve.withColumn("_n", above("n")).withColumn("_h", above("hits"))
    return summed.select(
        *by, "point", (F.col("point") * F.lit(step)).alias("threshold"),
        (F.col("_n") / F.col("_total")).alias("coverage"),
        F.when(F.col("_n") > 0, F.try_divide(F.col("_h"), F.col("_n"))).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def selective(tallied: DataFrame, gamma: float, by: list[str] | None = None) -> DataFrame:
    """Coverage and accuracy of the results whose normalised confidence reaches gamma."""
    kept = F.col("confidence") >= gamma
    sums = tallied.groupBy(*(by or BY)).agg(
        F.sum("n").alias("_n"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_answered"),
        F.coalesce(F.sum(F.when(kept, F.col("hits"))), F.lit(0)).alias("_h"),
    )
    return sums.select(
        *(by or BY), F.lit(gamma).alias("abstain_threshold"),
        (F.col("n_answered") / F.col("_n")).alias("coverage"),
        F.coalesce(F.try_divide(F.col("_h"), F.col("n_answered")), F.lit(0.0)).alias("selective_accuracy"),
        "n_answered", (F.col("_n") - F.col("n_answered")).alias("n_abstained"),
    )


def evaluate(results: DataFrame, gamma: float | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per group with every metric. The results are read once, for the tally."""
    by = by or BY
    scaled = normalised(tally(results, by), by)
    parts = [calibration_error(scaled, by), spearman(scaled, by), pearson(scaled, by)]
    if gamma is not None:
        parts.append(selective(scaled, gamma, by))
    out = accuracy(scaled, by)
    for part in parts:
        out = out.join(part, by)
    return out


def final_answers(answered: DataFrame, gamma: float, by: list[str] | None = None) -> DataFrame:
    """Answers after selective abstention on the normalised confidence."""
    by = by or BY
    bounds = answered.groupBy(*by).agg(F.min("confidence").alias("_lo"), F.max("confidence").alias("_hi"))
    c, lo, hi = F.col("confidence"), F.col("_lo"), F.col("_hi")
    scaled = F.when((lo >= 0) & (hi <= 1), c).when(hi > lo, F.try_divide(c - lo, hi - lo)).otherwise(F.lit(0.5))
    wide = join_group_stats(answered, bounds, by)
    return wide.withColumn("answer", F.when(scaled >= gamma, F.col("answer")).otherwise(ABSTAIN_TEXT)).drop(
        "_lo", "_hi"
    )


def answer_table(answered: DataFrame, methods: list[str]) -> DataFrame:
    """One row per (dataset, query): its text (`query`) and golds, and answer and confidence of each method.

    Text and golds are one query's, whatever methods answered it.
    """
    aggs = [F.max("query").alias("query")] if "query" in answered.columns else []
    for m in methods:
        mine = F.col("method") == m
        aggs += [
            F.max(F.when(mine, F.col("answer"))).alias(f"answer_{m}"),
            F.max(F.when(mine, F.col("confidence"))).alias(f"confidence_{m}"),
        ]
    return answered.groupBy("dataset", "query_id").agg(F.max("golds").alias("golds"), *aggs)
