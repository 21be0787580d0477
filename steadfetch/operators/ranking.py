"""Losses and ranking metrics over groups of scored documents.

Rows are (key, pos, logit, label): `pos` orders a group's documents and breaks ties.
No step holds a whole group in one task: limits prune before the shuffle, sums combine
before it, and figures that return to a group's rows go through a split join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LISTWISE_MODE
from .skew import split_hot_join

# Logits are summed as exp(x - edge of their band), so no exponent can overflow.
_BAND = 64.0


def bce(logit: Column, label: Column) -> Column:
    """Logistic loss with logits, in its overflow-free form."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def pointwise_loss(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(bce(F.col("logit"), F.col("label"))).alias("pointwise_loss"))


def listwise_losses(rows: DataFrame, tau: float = 1.0) -> DataFrame:
    """Loss per group: cross entropy of label shares against softmax(logit / tau).

    Since the shares sum to one it is logsumexp(x) - sum(label * x) / sum(label). The
    log-sum-exp adds up per (group, band of x) first; a group then has one row per band.
    Groups need a listwise mode, two documents and a positive label sum.
    """
    x = F.col("logit") / F.lit(tau)
    banded = rows.where(F.col("train_mode") == LISTWISE_MODE).withColumn("_x", x).withColumn(
        "_band", F.floor(F.col("_x") / _BAND)
    )
    bands = banded.groupBy("key", "_band").agg(
        F.sum(F.exp(F.col("_x") - F.col("_band") * _BAND)).alias("_s"),
        F.sum("label").alias("_l"),
        F.sum(F.col("label") * F.col("_x")).alias("_lx"),
        F.count(F.lit(1)).alias("_n"),
    )
    top = F.max("_band").over(Window.partitionBy("key"))  # one row per band of the group
    lse = F.log(F.sum(F.col("_s") * F.exp((F.col("_band") - F.col("_top")) * _BAND))) + F.max("_top") * _BAND
    totals = bands.withColumn("_top", top).groupBy("key").agg(
        lse.alias("_lse"), F.sum("_l").alias("_l"), F.sum("_lx").alias("_lx"), F.sum("_n").alias("n_docs")
    )
    return totals.where((F.col("n_docs") > 1) & (F.col("_l") > 0)).select(
        "key", "n_docs", (F.col("_lse") - F.col("_lx") / F.greatest("_l", F.lit(1e-8))).alias("listwise_loss")
    )


def hybrid_loss(rows: DataFrame, tau: float = 1.0) -> DataFrame:
    """One row: pointwise mean, listwise mean over groups (0 when none), and their sum."""
    listwise = listwise_losses(rows, tau).agg(
        F.coalesce(F.avg("listwise_loss"), F.lit(0.0)).alias("listwise_loss")
    )
    both = pointwise_loss(rows).withColumn("_one", F.lit(1)).join(
        listwise.withColumn("_one", F.lit(1)), "_one"  # one row each
    )
    return both.select(
        "pointwise_loss", "listwise_loss", (F.col("pointwise_loss") + F.col("listwise_loss")).alias("hybrid_loss")
    )


def ndcg(rows: DataFrame, depth: int = 3) -> DataFrame:
    """NDCG per group with linear gain and discount log2(place + 2)."""
    def gain(order: list[Column], name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
        top = rows.select("key", "pos", "logit", "label").withColumn("_n", place).where(F.col("_n") <= depth)
        return top.groupBy("key").agg(F.sum(F.col("label") / F.log2(F.col("_n") + 1.0)).alias(name))

    got = gain([F.desc("logit"), F.asc("pos")], "dcg")
    best = gain([F.desc("label"), F.asc("pos")], "ideal")
    return got.join(best, "key").select(
        "key", (F.col("dcg") / F.greatest("ideal", F.lit(1e-8))).alias("ndcg")
    )


def reciprocal_ranks(rows: DataFrame) -> DataFrame:
    """1 / place of the first document with a label above 0; 0 for groups without one.

    The best positive of each group comes from a combining aggregate; the documents
    ahead of it are counted, not ranked.
    """
    place = F.struct((-F.col("logit")).alias("s"), F.col("pos").alias("p"))
    best = rows.groupBy("key").agg(F.min(F.when(F.col("label") > 0, place)).alias("_best"))
    narrow = rows.select("key", "pos", "logit")
    ahead = split_hot_join(narrow, best, ["key"], "key").groupBy("key").agg(
        F.count_if(place < F.col("_best")).alias("_ahead"), F.count("_best").alias("_found")
    )
    return ahead.select(
        "key", F.when(F.col("_found") > 0, 1 / (F.col("_ahead") + 1)).otherwise(F.lit(0.0)).alias("rr")
    )


def score_gap(rows: DataFrame, score: Column, is_positive: Column) -> DataFrame:
    """One row: mean and population deviation of positive and negative scores, and the gap."""
    pos, neg = F.when(is_positive, score), F.when(~is_positive, score)
    zero = F.lit(0.0)
    return rows.agg(
        F.coalesce(F.avg(pos), zero).alias("pos_mean"), F.coalesce(F.stddev_pop(pos), zero).alias("pos_std"),
        F.coalesce(F.avg(neg), zero).alias("neg_mean"), F.coalesce(F.stddev_pop(neg), zero).alias("neg_std"),
    ).withColumn("gap", F.col("pos_mean") - F.col("neg_mean"))


def validation_report(rows: DataFrame, score: Column, is_positive: Column, tau: float = 1.0) -> DataFrame:
    """One row with every validation figure."""
    one = F.lit(1)
    parts = [
        hybrid_loss(rows, tau),
        ndcg(rows).agg(F.avg("ndcg").alias("ndcg")),
        reciprocal_ranks(rows).agg(F.avg("rr").alias("mrr")),
        score_gap(rows, score, is_positive),
    ]
    out = parts[0].withColumn("_one", one)
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", one), "_one")  # one row each
    return out.drop("_one")


def best_run(runs: DataFrame, by: str = "ndcg") -> DataFrame:
    """The run with the best metric; of equals the earliest. val_loss is best when low."""
    metric = F.col(by) if by == "val_loss" else -F.col(by)
    chosen = runs.agg(F.min_by(F.struct("model_tag", "step", by), F.struct(metric, F.col("step"))).alias("_b"))
    return chosen.select("_b.*")
