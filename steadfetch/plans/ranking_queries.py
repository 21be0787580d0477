"""Splits, sampling, losses and ranking metrics over lineitem, grouped by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..operators import critic, groups, ranking, splits
from ..session import settle
from ..sources.tables import given
from .catalog import query, sql_hash, with_ctes
from .pool_queries import RECORDS, ordered, plain_records, text_records
from .question_queries import sql_norm

KEYS = [RECORDS, """keys AS (
  SELECT query_idx || '_' || pert_idx AS key, query_idx, pert_idx,
         count(*) AS n_docs FROM records GROUP BY query_idx, pert_idx
),
ids AS (SELECT DISTINCT query_idx FROM keys),
numbered AS (
  SELECT query_idx, row_number() OVER (ORDER BY """ + sql_hash("42", "query_idx") + """, query_idx) - 1 AS ordinal FROM ids
)"""]


def keyed_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_counts(plain_records(spark, folder))


@query("j1_query_ids", with_ctes("SELECT query_idx FROM ids", *KEYS))
def query_ids(spark: SparkSession, folder: str) -> DataFrame:
    return splits.query_ids(keyed_groups(spark, folder))


@query("j2_folds", with_ctes("SELECT query_idx, ordinal % 5 AS fold FROM numbered", *KEYS))
def folds(spark: SparkSession, folder: str) -> DataFrame:
    return splits.folds(splits.query_ids(keyed_groups(spark, folder)))


@query("j3_hold_out", with_ctes(
    "SELECT query_idx FROM numbered WHERE ordinal < greatest(1, floor(0.05 * (SELECT count(*) FROM ids)))", *KEYS))
def hold_out(spark: SparkSession, folder: str) -> DataFrame:
    return splits.hold_out(splits.query_ids(keyed_groups(spark, folder)))


@query("j4_split_by_query", with_ctes(
    "SELECT key, CASE WHEN ordinal < greatest(1, floor(0.05 * (SELECT count(*) FROM ids))) THEN 'validation' ELSE 'training' END AS side "
    "FROM keys JOIN numbered USING (query_idx)", *KEYS))
def split_by_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed_groups(spark, folder)
    train, val = splits.split_groups(rows, splits.hold_out(splits.query_ids(rows)))
    return train.select("key", F.lit("training").alias("side")).unionByName(
        val.select("key", F.lit("validation").alias("side"))
    )


# Groups in array form: documents of an order and line class, ordered by part, supplier, price.
ARRAYS = RECORDS + """,
docs AS (
  SELECT query_idx || '_' || pert_idx AS key, robustness_score AS score,
         row_number() OVER (PARTITION BY query_idx, pert_idx ORDER BY doc_rank, l_suppkey, l_extendedprice) - 1 AS place
  FROM records
),
items AS (
  SELECT key, place AS pos_at, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS item_no FROM docs WHERE score > 0
)"""


def array_groups(spark: SparkSession, folder: str) -> DataFrame:
    nested = groups.nest_groups(ordered(spark, folder), fields=("doc_ord", "score"))
    return nested.select(
        "key", "part_no", F.transform("docs", lambda d: d["score"] > 0).alias("pos_mask"),
        F.transform("docs", lambda d: d["score"]).alias("scores"),
    )


@query("j5_positive_items", with_ctes("SELECT key, item_no, pos_at FROM items", ARRAYS))
def positive_items(spark: SparkSession, folder: str) -> DataFrame:
    return splits.positive_items(array_groups(spark, folder)).select(
        "key", F.col("item_no").cast("bigint").alias("item_no"), F.col("pos_at").cast("bigint").alias("pos_at")
    )


def picked_sql(first: str, condition: str) -> str:
    """The first document, then two negatives by number: the second draw steps over the first."""
    h = [f"({sql_hash('42', '0', 'i.key', 'i.item_no', str(j))})" for j in (0, 1)]
    one, two = f"{h[0]} % n.m", f"{h[1]} % greatest(n.m - 1, 1)"
    return f"""negs AS (
  SELECT key, place, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS num, count(*) OVER (PARTITION BY key) AS m
  FROM docs d WHERE {condition}
),
picked AS (
  SELECT key, item_no, 0 AS ord, {first} AS place FROM items i
  UNION ALL
  SELECT i.key, i.item_no, 1, n.place FROM items i JOIN negs n ON n.key = i.key AND n.num = {one}
  UNION ALL
  SELECT i.key, i.item_no, 2, n.place FROM items i JOIN negs n ON n.key = i.key AND n.m > 1
    AND n.num = {two} + ({two} >= {one})::INT
)"""


PICKED = "SELECT key, item_no, string_agg(place, ',' ORDER BY ord) AS picked FROM picked GROUP BY key, item_no"
REDRAWN = (
    "(SELECT j.pos_at FROM items j WHERE j.key = i.key AND j.item_no = "
    f"({sql_hash('42', '0', 'i.key', 'i.item_no')}) % (SELECT count(*) FROM items n WHERE n.key = i.key))"
)


def show_picked(df: DataFrame) -> DataFrame:
    return df.select(
        "key", F.col("item_no").cast("bigint").alias("item_no"),
        F.array_join(F.transform("picked", lambda i: i.cast("string")), ",").alias("picked"),
    )


@query("j6_sampled_items", with_ctes(PICKED, ARRAYS, picked_sql("pos_at", "d.score <= 0")))
def sampled_items(spark: SparkSession, folder: str) -> DataFrame:
    return show_picked(splits.sample_over_parts(array_groups(spark, folder), n_neg=2))


@query("j6_redrawn_items", with_ctes(PICKED, ARRAYS, picked_sql(REDRAWN, "d.score = 0")))
def redrawn_items(spark: SparkSession, folder: str) -> DataFrame:
    return show_picked(splits.sample_over_parts(array_groups(spark, folder), n_neg=2, redraw_positive=True))


@query("j7_padded_batches", """
WITH seqs AS (SELECT doc_id, least(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 509 - 6) + 3 + 6 AS n FROM documents),
batched AS (SELECT doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM seqs)
SELECT doc_id, batch, max(n) OVER (PARTITION BY batch)::BIGINT AS padded, n::BIGINT AS unmasked FROM batched""")
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = groups.encode_records(text_records(spark, folder)).select("doc_id", "input_ids")
    out = splits.padded_batches(rows, [F.col("doc_id")])
    return out.select(
        "doc_id", "batch", F.size("input_ids").cast("bigint").alias("padded"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda acc, m: acc + m).alias("unmasked"),
    )


SCORED = """scored AS (
  SELECT l_orderkey AS key, (l_quantity - 25) / 10 AS logit, l_discount * 10 AS label,
         ((l_linenumber - 1) * 1000000 + l_partkey) * 1000000 + l_suppkey AS pos, l_linenumber = 1 AS is_first,
         CASE WHEN l_orderkey % 5 = 0 THEN 'pointwise_only' ELSE 'listwise+pointwise' END AS train_mode
  FROM lineitem
)"""
LISTWISE = """listwise AS (
  SELECT key, count(*) AS n_docs, ln(sum(exp(logit))) - sum(label * logit) / greatest(sum(label), 1e-8) AS loss
  FROM scored WHERE train_mode = 'listwise+pointwise' GROUP BY key HAVING count(*) > 1 AND sum(label) > 0
)"""
NDCG = """places AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY logit DESC, pos) AS r,
         row_number() OVER (PARTITION BY key ORDER BY label DESC, pos) AS b FROM scored
),
per_key AS (
  SELECT key, coalesce(sum(label / log2(r + 1)) FILTER (r <= 3), 0) / greatest(coalesce(sum(label / log2(b + 1)) FILTER (b <= 3), 0), 1e-8) AS ndcg,
         coalesce(1.0 / min(r) FILTER (label > 0), 0.0) AS rr
  FROM places GROUP BY key
)"""
BCE = "avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))))"
GAP = (
    "avg(s) FILTER (is_first) AS pos_mean, stddev_pop(s) FILTER (is_first) AS pos_std, "
    "avg(s) FILTER (NOT is_first) AS neg_mean, stddev_pop(s) FILTER (NOT is_first) AS neg_std"
)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    place = ((F.col("l_linenumber") - 1).cast("bigint") * 1000000 + F.col("l_partkey")) * 1000000 + F.col("l_suppkey")
    return given(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"), ((F.col("l_quantity") - 25) / 10).alias("logit"),
        (F.col("l_discount") * 10).alias("label"), place.alias("pos"), (F.col("l_linenumber") == 1).alias("is_first"),
        F.when(F.col("l_orderkey") % 5 == 0, "pointwise_only").otherwise("listwise+pointwise").alias("train_mode"),
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


PAIRS = f"""texts AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS y, {sql_hash('doc_id')} % 1000 / 1000 AS f1,
    list_distinct(string_split({sql_norm("concat('what does ', source, ' say in ', lang)")}, ' ')) AS q,
    list_distinct(string_split({sql_norm('text')}, ' ')) AS d
  FROM documents
),
pairs AS MATERIALIZED (
  SELECT 1.0::DOUBLE AS f0, f1, len(list_intersect(q, d)) / len(q) AS f2,
    len(list_intersect(q, d)) / len(list_distinct(q || d)) AS f3, ln(1 + len(d)) AS f4, y FROM texts
)"""


def newton_sql(steps: int = 12, n: int = 5) -> str:
    """Newton steps from zero over pairs (f0 .. f4, y), each solved by elimination; the last row of `fitted` is the fit."""
    k = range(n)
    sums = [f"sum((y - p) * f{i}) AS g{i}" for i in k] + [f"sum(p * (1 - p) * f{i} * f{j}) AS h{i}{j}" for i in k for j in k]
    before = "it, " + ", ".join(f"b{i}" for i in k)
    logit = " + ".join(f"b{i} * f{i}" for i in k)
    solved = f"(SELECT {before}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({logit}))) AS p FROM fitted, pairs WHERE it < {steps}) GROUP BY {before})"
    for c in k:
        left = [f"h{i}{j} - h{i}{c} * h{c}{j} / h{c}{c} AS h{i}{j}" if i != c else f"h{c}{j} / h{c}{c} AS h{c}{j}" for i in k for j in k]
        right = [f"g{i} - h{i}{c} * g{c} / h{c}{c} AS g{i}" if i != c else f"g{c} / h{c}{c} AS g{c}" for i in k]
        solved = f"(SELECT {before}, {', '.join(left + right)} FROM {solved})"
    zeros = ", ".join(f"0.0::DOUBLE AS b{i}" for i in k)
    moved = ", ".join(f"b{i} + g{i}" for i in k)
    return f"fitted AS (SELECT 0 AS it, {zeros} UNION ALL SELECT it + 1, {moved} FROM {solved})"


FITTED = ["RECURSIVE " + PAIRS, newton_sql(), "fit AS (SELECT * FROM fitted ORDER BY it DESC LIMIT 1)"]


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Features of (question, document) pairs; their labels come from the records, not from a feature."""
    score = F.pmod(stable_hash(F.col("doc_id")), F.lit(1000)) / 1000
    return settle(critic.pair_features(text_records(spark, folder).withColumn("retriever_score", score)).select(
        *critic.FEATURES, "robustness_score"
    ))


@query("j8_critic_coefficients", with_ctes(
    "SELECT unnest(['intercept', 'retriever_score', 'overlap', 'jaccard', 'log_words']) AS feature, "
    "round(unnest([b0, b1, b2, b3, b4]), 6) AS coefficient FROM fit", *FITTED))
def critic_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    model = critic.fit(text_pairs(spark, folder))
    rows = zip(["intercept", *model.features], [model.intercept, *model.coefficients])
    return spark.createDataFrame(list(rows), "feature string, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


@query("j8_j9_critic_fit", with_ctes(
    "SELECT y AS label, count(*) AS n_pairs, round(avg(1 / (1 + exp(-(b0 + b1 * f1 + b2 * f2 + b3 * f3 + b4 * f4)))), 6) AS mean_score "
    "FROM pairs, fit GROUP BY y", *FITTED))
def critic_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Fit on all pairs, then the mean score per label."""
    pairs = text_pairs(spark, folder)
    return critic.score(pairs, critic.fit(pairs)).groupBy(F.col("robustness_score").alias("label")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("rerank_score"), 6).alias("mean_score")
    )


@query("j9_sigmoid_scores", with_ctes(
    "SELECT key, pos, round(1 / (1 + exp(-logit)), 9) AS score FROM scored", SCORED))
def sigmoid_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    return rows.select("key", "pos", F.round(critic.sigmoid(F.col("logit")), 9).alias("score"))


@query("j10_pointwise_loss", with_ctes(f"SELECT round({BCE}, 9) AS pointwise_loss FROM scored", SCORED))
def pointwise_loss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.pointwise_loss(scored(spark, folder)), "pointwise_loss")


@query("j11_listwise_losses", with_ctes(
    "SELECT key, n_docs, round(loss, 9) AS listwise_loss FROM listwise", SCORED, LISTWISE))
def listwise_losses(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.listwise_losses(scored(spark, folder)), "listwise_loss")


@query("j12_hybrid_loss", with_ctes(
    f"SELECT round((SELECT {BCE} FROM scored), 9) AS pointwise_loss, round((SELECT avg(loss) FROM listwise), 9) AS listwise_loss, "
    f"round((SELECT {BCE} FROM scored) + (SELECT avg(loss) FROM listwise), 9) AS hybrid_loss", SCORED, LISTWISE))
def hybrid_loss(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.hybrid_loss(scored(spark, folder)), "pointwise_loss", "listwise_loss", "hybrid_loss")


@query("j13_ndcg", with_ctes("SELECT key, round(ndcg, 9) AS ndcg FROM per_key", SCORED, NDCG))
def ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.ndcg(scored(spark, folder)), "ndcg")


@query("j14_reciprocal_ranks", with_ctes("SELECT key, round(rr, 9) AS rr FROM per_key", SCORED, NDCG))
def reciprocal_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.reciprocal_ranks(scored(spark, folder)), "rr")


@query("j15_score_gap", with_ctes(
    "SELECT round(pos_mean, 9) AS pos_mean, round(pos_std, 9) AS pos_std, round(neg_mean, 9) AS neg_mean, "
    f"round(neg_std, 9) AS neg_std, round(pos_mean - neg_mean, 9) AS gap FROM (SELECT {GAP} FROM "
    "(SELECT *, 1 / (1 + exp(-logit)) AS s FROM scored))", SCORED))
def score_gap(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.score_gap(scored(spark, folder), critic.sigmoid(F.col("logit")), F.col("is_first"))
    return rounded(out, "pos_mean", "pos_std", "neg_mean", "neg_std", "gap")


@query("j15_validation_report", with_ctes(
    f"SELECT round((SELECT {BCE} FROM scored) + (SELECT avg(loss) FROM listwise), 9) AS hybrid_loss, "
    "round((SELECT avg(ndcg) FROM per_key), 9) AS ndcg, round((SELECT avg(rr) FROM per_key), 9) AS mrr", SCORED, LISTWISE, NDCG))
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    out = ranking.validation_report(scored(spark, folder), critic.sigmoid(F.col("logit")), F.col("is_first"))
    return rounded(out.select("hybrid_loss", "ndcg", "mrr"), "hybrid_loss", "ndcg", "mrr")


RUNS = """runs AS (
  SELECT 'run' || l_suppkey AS model_tag, l_suppkey AS step, round(avg(l_tax), 4) AS val_loss, round(avg(l_discount), 4) AS ndcg
  FROM lineitem GROUP BY l_suppkey
)"""


@query("j16_best_run", with_ctes(
    "SELECT 'val_loss' AS metric, * FROM (SELECT model_tag, step, val_loss AS value FROM runs ORDER BY val_loss, step LIMIT 1) "
    "UNION ALL SELECT 'ndcg', * FROM (SELECT model_tag, step, ndcg FROM runs ORDER BY ndcg DESC, step LIMIT 1)", RUNS))
def best_run(spark: SparkSession, folder: str) -> DataFrame:
    runs = given(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("step")).agg(
        F.round(F.avg("l_tax"), 4).alias("val_loss"), F.round(F.avg("l_discount"), 4).alias("ndcg")
    ).withColumn("model_tag", F.concat(F.lit("run"), F.col("step").cast("string")))
    low = ranking.best_run(runs, "val_loss").select(F.lit("val_loss").alias("metric"), "model_tag", "step", F.col("val_loss").alias("value"))
    high = ranking.best_run(runs, "ndcg").select(F.lit("ndcg").alias("metric"), "model_tag", "step", F.col("ndcg").alias("value"))
    return low.unionByName(high)
