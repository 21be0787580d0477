import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from steadfetch.operators import critic, evaluation as ev, ranking

SCHEMA = "dataset string, method string, confidence double, correct boolean"


def tallied(spark, conf, correct, scale=False):
    df = spark.createDataFrame([("d", "m", float(c), bool(k)) for c, k in zip(conf, correct)], SCHEMA)
    out = ev.tally(df)
    return ev.normalised(out) if scale else out


def plain_ece(conf, correct, n_bins=10):
    conf, correct = np.array(conf), np.array(correct, float)
    edges, ece, mce = np.linspace(0, 1, n_bins + 1), 0.0, 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = (conf >= lo) & (conf < hi)
        if inside.any():
            gap = abs(correct[inside].mean() - conf[inside].mean())
            ece, mce = ece + inside.sum() / len(conf) * gap, max(mce, gap)
    return ece, mce


@pytest.mark.parametrize("conf", [
    [0.0, 0.1, 0.3, 0.6, 0.7, 1.0], [1.0], [0.5], [0.29999999999999999, 0.3, 0.30000000000000004],
    list(np.linspace(0, 1, 101)), [math.nextafter(1, 0), 1.0, 1.0],
])
def test_calibration_error(spark, conf):
    correct = [i % 3 == 0 for i in range(len(conf))]
    row = ev.calibration_error(tallied(spark, conf, correct)).first()
    assert (row["ece"], row["mce"]) == pytest.approx(plain_ece(conf, correct), abs=1e-12)


def test_closed_last_bin(spark):
    open_ = ev.calibration_error(tallied(spark, [1.0, 1.0], [True, False])).first()
    closed = ev.calibration_error(tallied(spark, [1.0, 1.0], [True, False]), include_right=True).first()
    assert (open_["ece"], closed["ece"]) == (0.0, 0.5)


@pytest.mark.parametrize("conf, expected", [
    ([0.0, 0.4, 1.0], [0.0, 0.4, 1.0]), ([-1.0, 0.0, 3.0], [0.0, 0.25, 1.0]), ([7.0, 7.0], [0.5, 0.5]),
    ([0.2, 0.2], [0.2, 0.2]),
])
def test_normalised(spark, conf, expected):
    got = tallied(spark, conf, [True] * len(conf), scale=True)
    values = sorted(v for r in got.collect() for v in [r["confidence"]] * r["n"])
    assert values == pytest.approx(expected)


def test_curve_equals_numpy(spark):
    rng = np.random.default_rng(0)
    conf = np.concatenate([rng.random(400), np.linspace(0, 1, 100), [0.0, 1.0]])
    correct = rng.random(len(conf)) < 0.4
    rows = ev.risk_coverage(tallied(spark, conf, correct)).orderBy("point").collect()
    for r, t in zip(rows, np.linspace(0, 1, 100)):
        kept = conf >= t
        assert r["threshold"] == pytest.approx(t, abs=1e-15)
        assert r["coverage"] == pytest.approx(kept.mean())
        assert r["accuracy"] == pytest.approx(correct[kept].mean() if kept.any() else 0.0)
    cover = [r["coverage"] for r in rows]
    assert cover == sorted(cover, reverse=True)


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(2)
    conf = rng.random(500).round(2)
    correct = rng.random(500) < conf
    t = tallied(spark, conf, correct)
    ranks, flag = pd.Series(conf).rank(), pd.Series(correct.astype(float))
    assert ev.spearman(t).first()["spearman_rho"] == pytest.approx(ranks.corr(flag), abs=1e-12)
    assert ev.pearson(t).first()["pearson_r"] == pytest.approx(pd.Series(conf).corr(flag), abs=1e-12)


@pytest.mark.parametrize("conf, correct", [([0.3, 0.3, 0.3], [True, False, True]), ([0.1, 0.2], [True, True]), ([0.5], [True])])
def test_constant_columns_have_no_correlation(spark, conf, correct):
    t = tallied(spark, conf, correct)
    assert ev.spearman(t).first()["spearman_rho"] is None
    assert ev.pearson(t).first()["pearson_r"] is None


def test_evaluate_one_row_per_method(spark):
    df = spark.createDataFrame(
        [(d, m, (i % 10) / 10, i % 2 == 0) for d in "xy" for m in "ab" for i in range(40)], SCHEMA
    )
    rows = ev.evaluate(df, 0.5).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["ece"] <= r["mce"] <= 1 and r["n_answered"] + r["n_abstained"] == r["n_examples"] == 40


def gate(spark, gamma, scores, retrieval=(0.9, 0.8, 0.7, 0.6)):
    queries = spark.createDataFrame([("d", "m", 1), ("d", "m", 2)], "dataset string, method string, query_id bigint")
    docs = [("d", "m", 1, i, f"t{i}", retrieval[i], s) for i, s in enumerate(scores)]
    ranked = spark.createDataFrame(
        docs, "dataset string, method string, query_id bigint, new_rank int, text string, score double, rerank_score double"
    )
    rows = {r["query_id"]: r for r in ev.contexts(queries, ranked, gamma).collect()}
    return (rows[1]["abstained"], rows[1]["context"], rows[1]["confidence"]), (
        rows[2]["abstained"], rows[2]["context"], rows[2]["confidence"])


def test_gate(spark):
    none = (False, [], 0.0)
    assert gate(spark, 0.5, [0.5, 0.4]) == ((False, ["t0"], 0.5), none)
    assert gate(spark, 0.5, [0.49, 0.4]) == ((True, [], 0.49), none)
    assert gate(spark, 0.1, [0.9, 0.8, 0.7, 0.6]) == ((False, ["t0", "t1", "t2"], 0.9), none)
    assert gate(spark, None, [0.1, 0.0]) == ((False, ["t0", "t1"], 0.1), none)
    assert gate(spark, 0.95, [None, None]) == ((False, ["t0", "t1"], 0.9), none)


ROWS = "key int, pos int, logit double, label double, train_mode string"


def ranking_rows(spark, groups):
    data = [
        (k, p, float(x), float(y), mode)
        for k, (mode, docs) in enumerate(groups) for p, (x, y) in enumerate(docs)
    ]
    return spark.createDataFrame(data, ROWS)


LW, PW = "listwise+pointwise", "pointwise_only"
GROUPS = [
    (LW, [(2, 0.5), (1, 0), (3, 0), (-700, 1)]), (LW, [(1, 0), (2, 0)]), (LW, [(1, 1)]), (PW, [(1, 1), (0, 0)]),
    (LW, [(900, 1), (899, 0.2), (-900, 0)]), (LW, [(1, 1), (1, 0), (1, 0.5), (1, 0)]),
]


def test_listwise_loss(spark):
    got = {r["key"]: r["listwise_loss"] for r in ranking.listwise_losses(ranking_rows(spark, GROUPS)).collect()}
    expected = {}
    for k in (0, 4, 5):
        x, y = np.array([d[0] for d in GROUPS[k][1]], float), np.array([d[1] for d in GROUPS[k][1]], float)
        logp = x - x.max() - np.log(np.exp(x - x.max()).sum())
        expected[k] = float(-(y / y.sum() * logp).sum())
    assert got == pytest.approx(expected, rel=1e-12)


def test_no_listwise_group_gives_zero(spark):
    row = ranking.hybrid_loss(ranking_rows(spark, [(PW, [(0, 1)])])).first()
    assert row["listwise_loss"] == 0.0 and row["pointwise_loss"] == pytest.approx(math.log(2))


def test_ndcg_and_reciprocal_rank(spark):
    df = ranking_rows(spark, GROUPS)
    nd = {r["key"]: r["ndcg"] for r in ranking.ndcg(df).collect()}
    rr = {r["key"]: r["rr"] for r in ranking.reciprocal_ranks(df).collect()}
    for k, (_, docs) in enumerate(GROUPS):
        order = sorted(range(len(docs)), key=lambda i: -docs[i][0])
        dcg = sum(docs[i][1] / math.log2(r + 2) for r, i in enumerate(order[:3]))
        ideal = sum(y / math.log2(r + 2) for r, y in enumerate(sorted((d[1] for d in docs), reverse=True)[:3]))
        assert nd[k] == pytest.approx(dcg / max(ideal, 1e-8))
        firsts = [r for r, i in enumerate(order) if docs[i][1] > 0]
        assert rr[k] == pytest.approx(1 / (firsts[0] + 1) if firsts else 0.0)


def test_soft_label_fit_follows_the_labels(spark):
    pairs = spark.range(200).select(
        (F.col("id") / 200).alias("retriever_score"), F.lit(0.0).alias("overlap"), F.lit(0.0).alias("jaccard"),
        F.lit(1.0).alias("log_words"), (F.col("id") / 200).alias("robustness_score"),
    )
    scored = critic.score(pairs, critic.fit(pairs)).agg(
        F.corr("rerank_score", "robustness_score"), F.avg("rerank_score")
    ).first()
    assert scored[0] > 0.99 and scored[1] == pytest.approx(0.4975, abs=1e-3)


def test_batch_critic(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    got = [r["rerank_score"] for r in critic.score_with(df, lambda pdf: pdf["x"]).orderBy("x").collect()]
    assert got == pytest.approx([0.5, 1 / (1 + math.exp(-2))])


def test_best_run(spark):
    runs = spark.createDataFrame([("a", 1, 0.5, 0.3), ("b", 2, 0.4, 0.9), ("c", 3, 0.4, 0.9)],
                                 "model_tag string, step int, val_loss double, ndcg double")
    assert ranking.best_run(runs, "val_loss").first()["model_tag"] == "b"
    assert ranking.best_run(runs, "ndcg").first()["model_tag"] == "b"
