"""The critic: a soft-label logistic model over (question, passage) features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_norm
from ..session import settle
from .inference import BatchFn, apply_batches
from pyspark.sql import types as T

FEATURES = ["retriever_score", "overlap", "jaccard", "log_words"]


def pair_features(pairs: DataFrame, question: str = "question", document: str = "document") -> DataFrame:
    """Lexical features of a pair; `retriever_score` comes with it."""
    split = pairs.withColumn("_q", F.array_distinct(F.split(simple_norm(F.col(question)), " "))).withColumn(
        "_d", F.array_distinct(F.split(simple_norm(F.col(document)), " "))
    )
    shared = F.size(F.array_intersect("_q", "_d"))
    return split.withColumns({
        "overlap": shared / F.size("_q"),
        "jaccard": shared / F.size(F.array_union("_q", "_d")),
        "log_words": F.log1p(F.size("_d")),
    }).drop("_q", "_d")


@dataclass(frozen=True)
class Critic:
    """A fitted critic: probability = sigmoid(intercept + sum of coefficient x feature); `loss` is the mean at the fit."""
    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    loss: float
    steps: int


def _sums(pairs: DataFrame, features: list[str], label: str, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient and second moments at `weights`, in one aggregate over the pairs."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    logit = sum((w * v for w, v in zip(map(float, weights), x)), F.lit(0.0))
    rows = pairs.select(*[v.alias(f"x{k}") for k, v in enumerate(x)], F.col(label).cast("double").alias("y"), logit.alias("z"))
    rows = rows.where("y IS NOT NULL AND z IS NOT NULL").withColumn("p", sigmoid(F.col("z")))
    n = len(x)
    loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    spread = F.col("p") * (1 - F.col("p"))
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    found = rows.agg(
        F.count(F.lit(1)), F.sum(loss), *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{k}")) for k in range(n)],
        *[F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper],
    ).first()
    if not found[0]:
        raise ValueError("no pair has a label and all features")
    moments = np.zeros((n, n))
    for (i, j), value in zip(upper, found[2 + n :]):
        moments[i, j] = moments[j, i] = value
    return found[1] / found[0], np.array(found[2 : 2 + n]), moments, found[0]


def fit(
    pairs: DataFrame, label: str = "robustness_score", features: list[str] | None = None, max_iter: int = 50,
    reg: float = 0.0, tol: float = 1e-10,
) -> Critic:
    """Logistic loss with labels in [0, 1], least by Newton steps from zero.

    Each step is one aggregate of the gradient and the second moments of the features, so its cost does not depend on
    how pairs are dealt out and only some numbers per step reach the driver; features should be few. A step
    that raises the loss is halved. `reg` adds reg / 2 x |coefficients|^2 to the mean loss, the intercept apart. Features
    that do not vary get the least coefficients that fit. Pairs with a null label or feature take no part.
    """
    names = list(features or FEATURES)
    ridge = np.diag([0.0] + [reg] * len(names))
    weights, step = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    best = np.inf
    done = 0
    for done in range(1, max_iter + 1):
        loss, gradient, moments, rows = _sums(pairs, names, label, weights + step)
        total = loss + 0.5 * float((weights + step) @ ridge @ (weights + step))
        if total > best + 1e-14 * max(1.0, abs(best)) and np.abs(step).max() > tol:
            step = step / 2
            continue
        weights, best = weights + step, total
        step = np.linalg.lstsq(moments / rows + ridge, gradient / rows - ridge @ weights, rcond=1e-12)[0]
        if np.abs(step).max() <= tol:
            break
    return Critic(tuple(names), float(weights[0]), tuple(map(float, weights[1:])), float(best), done)


def score(pairs: DataFrame, model: Critic) -> DataFrame:
    """Adds `rerank_score`, the model's probability; a null feature gives null."""
    logit = sum((c * F.col(f).cast("double") for c, f in zip(model.coefficients, model.features)), F.lit(model.intercept))
    return pairs.withColumn("rerank_score", sigmoid(logit))


def score_with(
    pairs: DataFrame, logits: BatchFn, concurrency: int | None = None, inputs: list[str] | None = None
) -> DataFrame:
    """Adds `rerank_score` = sigmoid of a user model's logits, one call per Arrow batch; written once.

    Only `inputs` (all columns if none are named) go to the model. A pair whose call fails has null.
    """
    def run(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series(1.0 / (1.0 + np.exp(-np.asarray(logits(pdf), dtype=np.float64))))

    return settle(apply_batches(pairs, run, "rerank_score", T.DoubleType(), concurrency, inputs))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))
