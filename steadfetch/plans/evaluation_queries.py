"""Marking of answers and evaluation metrics over conversations and lineitem."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import stable_hash
from ..operators import evaluation as ev
from ..operators import marking
from ..sources.tables import given, spread
from .catalog import query, sql_hash, with_ctes

GAMMA = 0.4

# A user turn and the assistant's reply to it; golds are words of the reply.
CONV = """turns AS (
  SELECT u.conv_id * 100 + u.turn AS query_idx, u.text AS question, a.text AS reply,
         list_filter(string_split_regex(a.text, '\\s+'), lambda w: w <> '') AS w
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
),
conv AS (
  SELECT query_idx, question, reply, [array_to_string(w[1:3], ' '), array_to_string(w[4:5], ' ')] AS golds,
         CASE (""" + sql_hash("query_idx") + """) % 3 WHEN 0 THEN reply WHEN 1 THEN '  The ' || array_to_string(w[1:3], ', ') || '... ' ELSE question END AS prediction
  FROM turns
)"""


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    table = given(spark, folder, "conversations")
    asks = table.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = table.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    rows = asks.join(replies, ["conv_id", "turn"]).withColumn("_w", text.words(F.col("reply"))).withColumn(
        "query_idx", F.col("conv_id") * 100 + F.col("turn")
    )
    head, kind = F.slice("_w", 1, 3), F.pmod(stable_hash(F.col("query_idx")), F.lit(3))
    prediction = (
        F.when(kind == 0, F.col("reply"))
        .when(kind == 1, F.concat(F.lit("  The "), F.array_join(head, ", "), F.lit("... ")))
        .otherwise(F.col("question"))
    )
    return rows.select(
        "query_idx", "question", "reply",
        F.array(F.array_join(head, " "), F.array_join(F.slice("_w", 4, 2), " ")).alias("golds"),
        prediction.alias("prediction"),
    )


@query("h3_golds", with_ctes(
    "SELECT query_idx, array_to_string(list_filter(golds, lambda g: g <> ''), '|') AS golds FROM conv", CONV))
def golds(spark: SparkSession, folder: str) -> DataFrame:
    kept = text.golds_of(F.col("golds"), F.col("question"))
    return conversations(spark, folder).select("query_idx", F.array_join(kept, "|").alias("golds"))


@query("h4_h5_prompts", with_ctes(
    "SELECT query_idx, md5('Context: ' || reply[1:1400] || chr(10) || chr(10) || 'Question: ' || question[1:500]) AS teacher_md5, "
    "md5('Question: ' || question[1:500] || chr(10) || 'Ground-truth answer(s): ' || array_to_string(golds[1:8], ' | ') || chr(10) "
    "|| 'Prediction: ' || prediction[1:200] || chr(10) || chr(10) || 'Does the prediction match any of the ground truths? (yes/no)') AS judge_md5 "
    "FROM conv", CONV))
def marking_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "query_idx", F.md5(marking.teacher_user(F.col("reply"), F.col("question"))).alias("teacher_md5"),
        F.md5(marking.judge_user(F.col("question"), F.col("golds"), F.col("prediction"))).alias("judge_md5"),
    )


def sql_answer_norm(value: str) -> str:
    return (
        f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({value}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), "
        "lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
    )


@query("h7_exact_match", with_ctes(
    f"SELECT query_idx, norm, norm <> '' AND norm <> 'unknown' AND len(list_filter(golds, lambda g: {sql_answer_norm('g')} = norm)) > 0 AS is_match "
    f"FROM (SELECT *, {sql_answer_norm('prediction')} AS norm FROM conv)", CONV))
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "query_idx", text.answer_norm(F.col("prediction")).alias("norm"),
        text.exact_match_any(F.col("prediction"), F.col("golds")).alias("is_match"),
    )


SQL_PRED = "rtrim(trim(lower({0}), ' ' || chr(9) || chr(10) || chr(13)), '.')"


def sql_check(prediction: str) -> str:
    p = SQL_PRED.format(prediction)
    return (
        f"len(list_filter(golds, lambda g: length(trim(lower(g))) > 2 AND (contains({p}, trim(lower(g))) "
        f"OR (length({p}) > 3 AND contains(trim(lower(g)), {p}))))) > 0"
    )


# The teacher takes the first gold the context holds; every second context is another text.
MARKS = [CONV, """marked AS (
  SELECT *, coalesce(list_filter(golds, lambda g: contains(lower(context), lower(g)))[1], 'unknown') AS pred
  FROM (SELECT *, CASE WHEN query_idx % 2 = 0 THEN reply ELSE question END AS context FROM conv)
),
verdicts AS (
  SELECT *, CASE WHEN """ + sql_answer_norm("pred") + """ NOT IN ('', 'unknown') AND len(list_filter(golds, lambda g: """
         + sql_answer_norm("g") + " = " + sql_answer_norm("pred") + """)) > 0 THEN 'yes (em)'
         WHEN """ + sql_check("pred") + """ THEN 'yes' ELSE 'no' END AS judge_raw FROM marked
)"""]


def marking_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).withColumn(
        "text", F.when(F.col("query_idx") % 2 == 0, F.col("reply")).otherwise(F.col("question"))
    ).withColumn("perturbed_query", F.col("question"))


VERDICT_SQL = "SELECT query_idx, pred, judge_raw, starts_with(judge_raw, 'yes') AS correct FROM verdicts"


@query("h6_h9_lexical_marks", with_ctes(VERDICT_SQL, *MARKS))
def lexical_marks(spark: SparkSession, folder: str) -> DataFrame:
    return marking.mark(marking_pairs(spark, folder)).select("query_idx", "pred", "judge_raw", "correct")


def stand_in_teacher(batch: pd.DataFrame) -> pd.Series:
    """The lexical teacher as a batch function."""
    def one(row) -> str:
        low = row.text.lower()
        return next((g for g in row.golds if g.lower() in low), "unknown")

    return pd.Series([one(r) for r in batch.itertuples(index=False)])


def stand_in_judge(batch: pd.DataFrame) -> pd.Series:
    """A judge that says no: exact matches never reach it."""
    return pd.Series([" No "] * len(batch))


@query("h6_h9_model_marks", with_ctes(
    "SELECT query_idx, pred, CASE WHEN judge_raw = 'yes (em)' THEN judge_raw ELSE 'no' END AS judge_raw, "
    "judge_raw = 'yes (em)' AS correct FROM verdicts", *MARKS))
def model_marks(spark: SparkSession, folder: str) -> DataFrame:
    rows = marking.mark(marking_pairs(spark, folder), stand_in_teacher, stand_in_judge)
    return rows.select("query_idx", "pred", "judge_raw", "correct")


THOUGHT = """thought AS (
  SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body, (conv_id + turn) % 5 AS kind FROM conversations
),
sentences AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
         lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13))), lambda s: s <> '') AS s FROM thought
)"""


@query("i1_salvaged_answer", with_ctes(
    "SELECT conv_id, turn, CASE kind WHEN 0 THEN body WHEN 1 THEN 'Paris' WHEN 2 THEN body "
    "WHEN 3 THEN array_to_string(s[greatest(len(s) - 1, 1):len(s)], ' ') ELSE body END AS answer FROM sentences", THOUGHT))
def salvaged_answer(spark: SparkSession, folder: str) -> DataFrame:
    kind, body = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), F.col("text")
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>so</think>\n"), body))
        .when(kind == 1, F.concat(body, F.lit("</think> Paris ")))
        .when(kind == 2, F.concat(body, F.lit(" <think> and then")))
        .when(kind == 3, F.concat(F.lit(" <think>"), body))
        .otherwise(body)
    )
    return given(spark, folder, "conversations").select("conv_id", "turn", text.salvage_answer(raw).alias("answer"))


@query("i2_answer_match", with_ctes(
    f"SELECT query_idx, {sql_check('prediction')} AS correct FROM conv", CONV))
def answer_match(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(spark, folder).select(
        "query_idx", text.answer_matches(F.col("prediction"), F.col("golds")).alias("correct")
    )


# Candidates of a query are the lines of an order; the method reads two status halves.
CANDS = """cands AS (
  SELECT 'set' || (l_orderkey % 3) AS dataset, l_linestatus AS method, l_orderkey AS query_id, l_partkey, l_suppkey, l_linenumber,
         l_discount * 10 AS score, CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 END AS rerank_score,
         'part ' || l_partkey || ' from ' || l_suppkey AS text
  FROM lineitem
),
cut AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, method, query_id ORDER BY score DESC, l_partkey, l_suppkey, l_linenumber) - 1 AS rank
  FROM cands QUALIFY rank < 100
),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, method, query_id ORDER BY rerank_score DESC NULLS LAST, rank) - 1 AS new_rank FROM cut
)"""


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey")
    rows = spread(given(spark, folder, "lineitem")).select(
        F.concat(F.lit("set"), (key % 3).cast("string")).alias("dataset"), F.col("l_linestatus").alias("method"),
        key.alias("query_id"), "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") / 50).alias("rerank_score"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string")).alias("text"),
    )
    order = [F.desc("score"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")]
    return ev.retrieval_ranks(rows, order, depth=100)


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    return ev.rerank(candidates(spark, folder))


@query("i3_depth_cut", with_ctes(
    "SELECT dataset, method, query_id, rank, l_partkey, l_suppkey FROM cut WHERE rank < 4", CANDS))
def depth_cut(spark: SparkSession, folder: str) -> DataFrame:
    return ev.depth_cut(candidates(spark, folder), 4).select(
        "dataset", "method", "query_id", F.col("rank").cast("bigint").alias("rank"), "l_partkey", "l_suppkey"
    )


@query("i4_reranked", with_ctes(
    "SELECT dataset, method, query_id, rank, new_rank, text FROM reranked", CANDS))
def reranked_rows(spark: SparkSession, folder: str) -> DataFrame:
    return reranked(spark, folder).select(
        "dataset", "method", "query_id", F.col("rank").cast("bigint").alias("rank"),
        F.col("new_rank").cast("bigint").alias("new_rank"), "text",
    )


GATED = CANDS + f""",
queries AS (
  SELECT dataset, method, o_orderkey AS query_id FROM (SELECT o_orderkey, 'set' || (o_orderkey % 3) AS dataset FROM orders),
         (SELECT unnest(['O', 'F']) AS method)
),
tops AS (
  SELECT dataset, method, query_id, list(struct_pack(r := new_rank, g := rerank_score, t := text) ORDER BY new_rank) AS d,
         arg_min(coalesce(rerank_score, score), new_rank) AS conf, max(rerank_score) FILTER (new_rank = 0) AS best
  FROM reranked WHERE new_rank < 3 GROUP BY ALL
),
gated AS (
  SELECT q.dataset, q.method, q.query_id, coalesce(conf, 0.0) AS confidence, coalesce(best < {GAMMA}, false) AS abstained,
         CASE WHEN d IS NULL OR coalesce(best < {GAMMA}, false) THEN []::VARCHAR[]
              WHEN best IS NULL THEN list_transform(d, lambda x: x.t)
              ELSE list_transform(list_filter(d, lambda x: x.g >= {GAMMA}), lambda x: x.t) END AS context
  FROM queries q LEFT JOIN tops USING (dataset, method, query_id)
)"""


def query_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spread(given(spark, folder, "orders")).select(
        F.col("o_orderkey").alias("query_id"), F.concat(F.lit("set"), (F.col("o_orderkey") % 3).cast("string")).alias("dataset"),
        F.explode(F.array(F.lit("O"), F.lit("F"))).alias("method"),
        F.concat(F.lit("which part is in order "), F.col("o_orderkey").cast("string")).alias("query"),
        F.array(
            F.concat(F.lit("part "), (F.col("o_orderkey") % 7).cast("string")),
            F.concat(F.lit("from "), (F.col("o_orderkey") % 100).cast("string")),
        ).alias("golds"),
    )


def gated(spark: SparkSession, folder: str) -> DataFrame:
    return ev.contexts(query_rows(spark, folder), reranked(spark, folder), GAMMA)


@query("i5_i6_gated_evidence", with_ctes(
    "SELECT dataset, method, query_id, abstained, array_to_string(context, chr(10) || chr(10)) AS evidence FROM gated", GATED))
def gated_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).select(
        "dataset", "method", "query_id", "abstained", ev.evidence(F.col("context")).alias("evidence")
    )


@query("i8_confidence", with_ctes(
    "SELECT dataset, method, query_id, round(confidence, 9) AS confidence FROM gated", GATED))
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).select("dataset", "method", "query_id", F.round("confidence", 9).alias("confidence"))


ANSWERED = GATED + """,
answered AS (
  SELECT *, CASE WHEN abstained THEN 'Abstain: Insufficient reliable evidence'
            ELSE coalesce(list_filter(golds, lambda g: contains(lower(array_to_string(context, chr(10) || chr(10))), g))[1], 'unknown') END AS answer
  FROM (SELECT *, ['part ' || (query_id % 7), 'from ' || (query_id % 100)] AS golds FROM gated)
),
judged AS (SELECT *, """ + sql_check("answer") + """ AS correct FROM answered)"""
ANSWERS = "SELECT dataset, method, query_id, answer, correct FROM judged"


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return ev.judged(ev.answer(gated(spark, folder)))


@query("i7_answers", with_ctes(ANSWERS, ANSWERED))
def answers(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("dataset", "method", "query_id", "answer", "correct")


def stand_in_reader(batch: pd.DataFrame) -> pd.Series:
    """The lexical generator as a batch function with a reasoning block before its answer."""
    def one(row) -> str:
        held = "\n\n".join(row.context).lower()
        return "<think>reading</think> " + next((g for g in row.golds if g in held), "unknown")

    return pd.Series([one(r) for r in batch.itertuples(index=False)])


@query("i7_model_answers", with_ctes(ANSWERS, ANSWERED))
def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = ev.judged(ev.answer(gated(spark, folder), stand_in_reader))
    return rows.select("dataset", "method", "query_id", "answer", "correct")


# Every lineitem row is one result; the confidence is quantity / 50, or the price in the raw form.
RESULTS = """results AS (
  SELECT 'set' || (l_linenumber % 3) AS dataset, l_linestatus AS method, l_quantity / 50 AS confidence,
         l_extendedprice AS price, l_returnflag = 'R' AS correct
  FROM lineitem
)"""
SCALED = RESULTS + """,
scaled AS (
  SELECT dataset, method, correct, price, (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) AS confidence
  FROM results WINDOW w AS (PARTITION BY dataset, method)
)"""


def results(spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    value = F.col("l_extendedprice") if raw else F.col("l_quantity") / 50
    return given(spark, folder, "lineitem").select(
        F.concat(F.lit("set"), (F.col("l_linenumber") % 3).cast("string")).alias("dataset"),
        F.col("l_linestatus").alias("method"), value.alias("confidence"), (F.col("l_returnflag") == "R").alias("correct"),
    )


def tallied(spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    return ev.normalised(ev.tally(results(spark, folder, raw)))


def nine(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("i9_normalised_confidence", with_ctes(
    "SELECT dataset, method, price AS raw_confidence, round(confidence, 9) AS confidence, count(*) AS n FROM scaled GROUP BY ALL", SCALED))
def normalised_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return nine(tallied(spark, folder, True).select("dataset", "method", "raw_confidence", "confidence", "n"), "confidence")


@query("i10_accuracy", with_ctes(
    "SELECT dataset, method, count(*) AS n_examples, round(avg(correct::INT), 9) AS accuracy FROM results GROUP BY ALL", RESULTS))
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.accuracy(ev.tally(results(spark, folder))), "accuracy")


def ece_sql(source: str, right: bool = False) -> str:
    top = "confidence <= 1.0" if right else "false"
    return f"""bins AS (
  SELECT dataset, method, b, count(r.confidence) AS n, avg(correct::INT) AS acc, avg(confidence) AS conf
  FROM {source} r JOIN (SELECT i AS b, i * (1 / 10) AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * (1 / 10) END AS hi FROM range(10) t(i)) e
    ON confidence >= lo AND (confidence < hi OR (b = 9 AND {top}))
  GROUP BY dataset, method, b
),
totals AS (SELECT dataset, method, count(*) AS total FROM {source} GROUP BY ALL),
errors AS (
  SELECT dataset, method, sum(n / total * abs(acc - conf)) AS ece, max(abs(acc - conf)) AS mce
  FROM bins JOIN totals USING (dataset, method) GROUP BY ALL
)"""


ECE = "SELECT dataset, method, round(ece, 9) AS ece, round(mce, 9) AS mce FROM errors"


@query("i11_calibration_error", with_ctes(ECE, RESULTS, ece_sql("results")))
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.calibration_error(tallied(spark, folder)), "ece", "mce")


@query("i11_calibration_error_closed", with_ctes(ECE, RESULTS, ece_sql("results", True)))
def calibration_error_closed(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.calibration_error(tallied(spark, folder), include_right=True), "ece", "mce")


RANKS = """ranks AS (
  SELECT dataset, method, correct::INT AS y,
         rank() OVER (PARTITION BY dataset, method ORDER BY confidence)
           + (count(*) OVER (PARTITION BY dataset, method, confidence) - 1) / 2 AS r
  FROM {source}
)"""


@query("i12_spearman", with_ctes(
    "SELECT dataset, method, round(corr(r, y), 9) AS spearman_rho FROM ranks GROUP BY ALL", RESULTS, RANKS.format(source="results")))
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.spearman(tallied(spark, folder)), "spearman_rho")


@query("i12_spearman_scaled", with_ctes(
    "SELECT dataset, method, round(corr(r, y), 9) AS spearman_rho FROM ranks GROUP BY ALL", SCALED, RANKS.format(source="scaled")))
def spearman_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.spearman(tallied(spark, folder, True)), "spearman_rho")


@query("i13_pearson", with_ctes(
    "SELECT dataset, method, round(corr(confidence, correct::INT), 9) AS pearson_r FROM results GROUP BY ALL", RESULTS))
def pearson(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.pearson(tallied(spark, folder)), "pearson_r")


@query("i14_risk_coverage", with_ctes(
    "SELECT dataset, method, i::BIGINT AS point, round(i * (1 / 99), 9) AS threshold, "
    "round(sum((confidence >= i * (1 / 99))::INT) / count(*), 9) AS coverage, "
    "round(coalesce(sum((confidence >= i * (1 / 99) AND correct)::INT) / nullif(sum((confidence >= i * (1 / 99))::INT), 0), 0), 9) AS accuracy "
    "FROM results, range(100) t(i) GROUP BY ALL", RESULTS))
def risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.risk_coverage(tallied(spark, folder)), "threshold", "coverage", "accuracy").withColumn(
        "point", F.col("point").cast("bigint")
    )


SELECTIVE = (
    f"SELECT dataset, method, {GAMMA}::DOUBLE AS abstain_threshold, round(avg((confidence >= {GAMMA})::INT), 9) AS coverage, "
    f"round(coalesce(avg(correct::INT) FILTER (confidence >= {GAMMA}), 0), 9) AS selective_accuracy, "
    f"count(*) FILTER (confidence >= {GAMMA}) AS n_answered, count(*) FILTER (confidence < {GAMMA}) AS n_abstained FROM "
)


@query("i15_selective", with_ctes(SELECTIVE + "scaled GROUP BY ALL", SCALED))
def selective(spark: SparkSession, folder: str) -> DataFrame:
    return nine(ev.selective(tallied(spark, folder, True), GAMMA), "coverage", "selective_accuracy")


@query("i16_evaluation", with_ctes(
    "SELECT * FROM (SELECT dataset, method, count(*) AS n_examples, round(avg(correct::INT), 9) AS accuracy, "
    "round(corr(confidence, correct::INT), 9) AS pearson_r FROM scaled GROUP BY ALL) "
    f"JOIN ({ECE}) USING (dataset, method) "
    "JOIN (SELECT dataset, method, round(corr(r, y), 9) AS spearman_rho FROM ranks GROUP BY ALL) USING (dataset, method) "
    f"JOIN ({SELECTIVE} scaled GROUP BY ALL) USING (dataset, method)",
    SCALED, ece_sql("scaled"), RANKS.format(source="scaled")))
def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return nine(
        ev.evaluate(results(spark, folder, True), GAMMA),
        "accuracy", "pearson_r", "ece", "mce", "spearman_rho", "coverage", "selective_accuracy",
    )


@query("i16_end_to_end", with_ctes(
    "SELECT dataset, method, count(*) AS n_examples, round(avg(correct::INT), 9) AS accuracy, "
    "round(corr(confidence, correct::INT), 9) AS pearson_r, any_value(ece) AS ece, any_value(mce) AS mce "
    f"FROM judged JOIN ({ECE}) USING (dataset, method) GROUP BY dataset, method", ANSWERED, ece_sql("judged")))
def end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Rerank, gate, answer, judge and measure in one job over all orders."""
    out = ev.evaluate(judged(spark, folder))
    return nine(out, "accuracy", "pearson_r", "ece", "mce").drop("spearman_rho")


@query("i17_answer_table", with_ctes(
    "SELECT dataset, query_id, 'which part is in order ' || query_id AS query, max(array_to_string(golds, '|')) AS golds, "
    f"max(CASE WHEN method = 'O' THEN a END) AS \"answer_O\", max(CASE WHEN method = 'F' THEN a END) AS \"answer_F\", "
    "round(max(CASE WHEN method = 'O' THEN confidence END), 9) AS \"confidence_O\", round(max(CASE WHEN method = 'F' THEN confidence END), 9) AS \"confidence_F\" "
    f"FROM (SELECT *, CASE WHEN confidence >= {GAMMA} THEN answer ELSE 'Abstain: Insufficient reliable evidence' END AS a FROM judged) GROUP BY dataset, query_id",
    ANSWERED))
def answer_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = ev.final_answers(judged(spark, folder), GAMMA)
    out = ev.answer_table(rows, ["O", "F"])
    return nine(out.withColumn("golds", F.array_join("golds", "|")), "confidence_O", "confidence_F")
