"""Pools, marks and training groups over candidate lists from lineitem.

A supplier stands for a query and a part for a document. Rows with return flag N are its
clean hits, the others are hits of five rewrites. Some documents come with the older id
column and some with their text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import groups, marking, pool
from ..session import settle
from ..sources.tables import given, spread
from .catalog import query, sql_hash, sql_words, with_ctes

N_NEG = 10

LISTS = """lists AS (
  SELECT l_suppkey AS query_idx, l_returnflag = 'N' AS is_clean, (l_linenumber % 5)::BIGINT AS pert_idx,
         (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS rank,
         CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END AS passage_idx,
         CASE WHEN l_partkey % 20 = 0 THEN l_partkey END AS idx,
         'supplier ' || l_suppkey || ' part ' || l_partkey AS text,
         CASE WHEN l_discount > 0.01 THEN l_discount END AS score
  FROM lineitem
),
keyed AS (
  SELECT query_idx, is_clean, CASE WHEN is_clean THEN -1 ELSE pert_idx END AS pert_idx,
         CASE WHEN is_clean THEN 0 ELSE 1 END AS src, rank, coalesce(passage_idx, idx) AS passage_idx, text,
         coalesce(score, 0.0) AS score,
         coalesce('pid:' || coalesce(passage_idx, idx), 'sha1:' || sha1(text)) AS doc_key
  FROM lists
),
asked AS (
  SELECT s_suppkey AS query_idx, 'where is supplier ' || s_suppkey AS question, s_name AS correct_answer,
         CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE [s_name, 'part'] END AS all_answers
  FROM supplier WHERE s_acctbal > 0
)"""
POOL = """known AS (SELECT * FROM keyed WHERE query_idx IN (SELECT query_idx FROM asked)),
once AS (
  SELECT * FROM known
  QUALIFY row_number() OVER (PARTITION BY query_idx, doc_key ORDER BY src, pert_idx, rank, score) = 1
),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY src, pert_idx, rank, doc_key) - 1 AS pool_rank FROM once
)"""
PERTS = """perts AS (
  SELECT query_idx, p AS pert_idx, p % 3 + 1 AS pert_type, question || ' or part ' || p AS perturbed_query,
         list_filter(coalesce(all_answers, [correct_answer]), lambda g: g IS NOT NULL AND g <> '') AS golds
  FROM asked, unnest(range(5)) AS r(p)
)"""
PAIRS = """pairs AS (
  SELECT pool.query_idx, pool_rank AS doc_rank, p.pert_idx, p.pert_type, p.perturbed_query, p.golds, text, score,
         passage_idx, doc_key,
         ((pool.query_idx * 31 + coalesce(passage_idx, length(text)) * 17) % 7 + p.pert_idx) % 7 < 2 AS correct
  FROM pool JOIN perts p USING (query_idx)
)"""
SCORES = """scores AS (
  SELECT query_idx, doc_key, count(*) AS n_marks, count(*) FILTER (correct) AS n_correct,
         (count(*) FILTER (correct)) / count(*) AS robustness
  FROM pairs GROUP BY query_idx, doc_key
)"""
BASE = [LISTS, POOL]
MARKED = [LISTS, POOL, PERTS, PAIRS]
SCORED = [*MARKED, SCORES]


def lists(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("l_partkey")
    return spread(given(spark, folder, "lineitem")).select(
        F.col("l_suppkey").alias("query_idx"),
        (F.col("l_returnflag") == "N").alias("is_clean"),
        F.pmod("l_linenumber", F.lit(5)).cast("int").alias("pert_idx"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + part).alias("rank"),
        F.when(part % 10 != 0, part).alias("passage_idx"),
        F.when(part % 20 == 0, part).alias("idx"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" part "), part.cast("string")).alias("text"),
        F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("score"),
    )


def clean_list(spark: SparkSession, folder: str, hot: list) -> DataFrame:
    """Clean hits of the known queries."""
    rows = lists(spark, folder).where("is_clean").drop("is_clean", "pert_idx")
    return pool.known_only(rows, asked(spark, folder), hot)


def perturbed_list(spark: SparkSession, folder: str) -> DataFrame:
    return lists(spark, folder).where(~F.col("is_clean")).drop("is_clean")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return given(spark, folder, "supplier").where("s_acctbal > 0").select(
        key.alias("query_idx"),
        F.concat(F.lit("where is supplier "), key.cast("string")).alias("question"),
        F.col("s_name").alias("correct_answer"),
        F.when(key % 3 != 0, F.array(F.col("s_name"), F.lit("part"))).alias("all_answers"),
    )


def hot_suppliers(spark: SparkSession, folder: str) -> list:
    """Queries with a large share of the candidates, from one narrow column."""
    return pool.hot_queries(given(spark, folder, "lineitem").select(F.col("l_suppkey").alias("query_idx")))


def pooled(spark: SparkSession, folder: str, cap: int = 0, hot: list | None = None) -> DataFrame:
    hot = hot_suppliers(spark, folder) if hot is None else hot
    return pool.build_pool(
        clean_list(spark, folder, hot), perturbed_list(spark, folder), asked(spark, folder), cap, hot
    )


def perts(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).withColumn(
        "golds", text.golds_of(F.col("all_answers"), F.col("correct_answer"))
    ).select(
        "query_idx", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pert_idx"), "question", "golds"
    ).select(
        "query_idx", "pert_idx", (F.col("pert_idx") % 3 + 1).alias("pert_type"), "golds",
        F.concat("question", F.lit(" or part "), F.col("pert_idx").cast("string")).alias("perturbed_query"),
    )


def given_mark() -> Column:
    document = F.coalesce("passage_idx", F.length("text").cast("bigint"))
    return (F.pmod(F.col("query_idx") * 31 + document * 17, F.lit(7)) + F.col("pert_idx")) % 7 < 2


def pairs(spark: SparkSession, folder: str, hot: list | None = None) -> DataFrame:
    """Pairs with a given mark, so that the steps after marking can be checked alone."""
    hot = hot_suppliers(spark, folder) if hot is None else hot
    docs = pooled(spark, folder, 0, hot).drop("src", "pert_idx", "rank")
    return marking.expand_pairs(docs, perts(spark, folder), hot).withColumn("correct", given_mark())


def scores(spark: SparkSession, folder: str, hot: list | None = None) -> DataFrame:
    return marking.robustness(pairs(spark, folder, hot))


@query("g1_document_keys", with_ctes("SELECT query_idx, rank, doc_key, score FROM keyed", LISTS))
def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    return pool.with_key(lists(spark, folder)).select("query_idx", "rank", "doc_key", "score")


@query("g2_g4_union_known", with_ctes(
    "SELECT query_idx, src::BIGINT AS src, count(*) AS n_rows, sum(rank)::DOUBLE AS rank_sum FROM known GROUP BY ALL", *BASE))
def union_known(spark: SparkSession, folder: str) -> DataFrame:
    hot = hot_suppliers(spark, folder)
    known = pool.known_only(perturbed_list(spark, folder), asked(spark, folder), hot)
    return pool.union_candidates(clean_list(spark, folder, hot), known).groupBy("query_idx", "src").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rank").cast("double").alias("rank_sum")
    ).withColumn("src", F.col("src").cast("bigint"))


POOL_COLUMNS = "SELECT query_idx, pool_rank, doc_key, passage_idx, text, score, src::BIGINT AS src, pert_idx::BIGINT AS pert_idx, rank FROM pool"


def pool_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "query_idx", "pool_rank", "doc_key", "passage_idx", "text", "score",
        F.col("src").cast("bigint").alias("src"), F.col("pert_idx").cast("bigint").alias("pert_idx"), "rank",
    )


@query("g3_deduplicated_pool", with_ctes(POOL_COLUMNS, *BASE))
def deduplicated_pool(spark: SparkSession, folder: str) -> DataFrame:
    return pool_columns(pooled(spark, folder))


@query("g5_last_clean_record", 
    "SELECT l_suppkey AS query_idx, max(l_orderkey * 8 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1")
def last_clean_record(spark: SparkSession, folder: str) -> DataFrame:
    rows = given(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("query_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal")
    )
    return pool.last_record(rows, ["query_idx"], "ordinal")


@query("g6_capped_pool", with_ctes(POOL_COLUMNS + " WHERE pool_rank < 100", *BASE))
def capped_pool(spark: SparkSession, folder: str) -> DataFrame:
    return pool_columns(pooled(spark, folder, 100))


@query("g7_defaults", with_ctes(
    "SELECT query_idx, correct_answer, array_to_string(coalesce(all_answers, []), '|') AS all_answers, "
    "len(list_filter(coalesce(all_answers, [correct_answer]), lambda g: g IS NOT NULL AND g <> ''))::BIGINT AS n_golds FROM asked", LISTS))
def defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Records with defaults for what is missing; golds fall back to the one answer."""
    rows = pool.nest_pool(asked(spark, folder), pooled(spark, folder)).where("part_no = 0")
    return rows.select(
        "query_idx", "correct_answer", F.array_join("all_answers", "|").alias("all_answers"),
        F.size(text.golds_of(F.col("all_answers"), F.col("correct_answer"))).cast("bigint").alias("n_golds"),
    )


def parts_joined(name: str) -> Column:
    """The strings of a key's parts, in order."""
    ordered_parts = F.array_sort(F.collect_list(F.struct("part_no", name)))
    return F.array_join(F.transform(ordered_parts, lambda x: x[name]), ",").alias(name)


@query("g8_nested_pool", with_ctes(
    "SELECT a.query_idx, any_value(question) AS question, count(p.doc_key) AS n_docs, "
    "md5(coalesce(string_agg(pool_rank || ':' || p.text, ',' ORDER BY pool_rank), '')) AS docs_md5 "
    "FROM asked a LEFT JOIN pool p USING (query_idx) GROUP BY a.query_idx", *BASE))
def nested_pool(spark: SparkSession, folder: str) -> DataFrame:
    rows = pool.nest_pool(asked(spark, folder), pooled(spark, folder))
    shown = F.transform("candidates", lambda c: F.concat_ws(":", c["pool_rank"].cast("string"), c["text"]))
    parts = rows.select("query_idx", "question", "part_no", F.size("candidates").alias("n"), F.array_join(shown, ",").alias("docs"))
    return parts.groupBy("query_idx").agg(
        F.min_by("question", "part_no").alias("question"), F.sum("n").alias("n_docs"),
        F.md5(parts_joined("docs")).alias("docs_md5"),
    )


@query("h1_expanded_pairs", with_ctes(
    "SELECT query_idx, pert_idx, doc_rank, doc_key, perturbed_query, array_to_string(golds, '|') AS golds FROM pairs", *MARKED))
def expanded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select(
        "query_idx", F.col("pert_idx").cast("bigint").alias("pert_idx"), "doc_rank", "doc_key", "perturbed_query",
        F.array_join("golds", "|").alias("golds"),
    )


@query("h2_pair_count", with_ctes(
    "SELECT count(DISTINCT query_idx) AS n_queries, count(*) AS n_pairs FROM pairs", *MARKED))
def pair_count(spark: SparkSession, folder: str) -> DataFrame:
    return marking.pair_count(pooled(spark, folder), perts(spark, folder))


VERDICTS = """verdicts AS (
  SELECT query_idx, pert_idx, doc_rank, correct, doc_key AS true_key, passage_idx,
         CASE WHEN doc_rank % 4 = 0 AND passage_idx IS NULL THEN '' ELSE sha1(text) END AS doc_text_hash
  FROM pairs
),
ranked AS (SELECT query_idx, pool_rank AS doc_rank, doc_key FROM pool),
resolved AS (
  SELECT v.query_idx, v.pert_idx, v.doc_rank, v.correct,
         coalesce('pid:' || passage_idx, CASE WHEN doc_text_hash <> '' THEN 'sha1:' || doc_text_hash END, r.doc_key) AS doc_key
  FROM verdicts v LEFT JOIN ranked r USING (query_idx, doc_rank)
)"""


@query("h11_resolved_keys", with_ctes(
    "SELECT query_idx, pert_idx, doc_rank, correct, doc_key FROM resolved WHERE doc_key IS NOT NULL", *MARKED, VERDICTS))
def resolved_keys(spark: SparkSession, folder: str) -> DataFrame:
    hot = hot_suppliers(spark, folder)
    docs = settle(pooled(spark, folder, 0, hot))
    marked = marking.expand_pairs(docs.drop("src", "pert_idx", "rank"), perts(spark, folder), hot)
    lost = (F.col("doc_rank") % 4 == 0) & F.col("passage_idx").isNull()
    verdicts = marked.withColumn("correct", given_mark()).select(
        "query_idx", F.col("pert_idx").cast("bigint").alias("pert_idx"), "doc_rank", "correct", "passage_idx",
        F.when(lost, "").otherwise(F.sha1(F.col("text").cast("binary"))).alias("doc_text_hash"),
    )
    ranked = docs.select("query_idx", F.col("pool_rank").alias("rank"), "doc_key")
    return marking.resolve_keys(verdicts, ranked).select("query_idx", "pert_idx", "doc_rank", "correct", "doc_key")


@query("h12_robustness", with_ctes(
    "SELECT query_idx, doc_key, n_marks, n_correct, round(robustness, 9) AS robustness FROM scores", *SCORED))
def robustness(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).withColumn("robustness", F.round("robustness", 9))


GROUPS = f"""pos AS (
  SELECT k.query_idx, k.doc_key, k.rank, k.text, k.score, s.robustness,
         row_number() OVER (PARTITION BY k.query_idx ORDER BY k.rank, k.doc_key, k.score) - 1 AS pick
  FROM keyed k JOIN scores s USING (query_idx, doc_key) WHERE k.is_clean AND s.robustness > 0
),
neg AS (
  SELECT k.* FROM (SELECT * FROM keyed WHERE NOT is_clean
    QUALIFY row_number() OVER (PARTITION BY query_idx, pert_idx, doc_key ORDER BY rank, score) = 1) k
  JOIN scores s USING (query_idx, doc_key) WHERE s.robustness = 0
),
records AS (SELECT DISTINCT query_idx, pert_idx FROM keyed WHERE NOT is_clean),
states AS (
  SELECT r.query_idx, r.pert_idx, coalesce(p.n, 0) AS n_pos, coalesce(n.n, 0) AS n_neg,
         CASE WHEN coalesce(p.n, 0) = 0 THEN 'no_positive' WHEN coalesce(n.n, 0) < {N_NEG} THEN 'few_negatives' ELSE 'kept' END AS state
  FROM records r
  LEFT JOIN (SELECT query_idx, count(*) AS n FROM pos GROUP BY 1) p USING (query_idx)
  LEFT JOIN (SELECT query_idx, pert_idx, count(*) AS n FROM neg GROUP BY 1, 2) n USING (query_idx, pert_idx)
  WHERE r.query_idx IN (SELECT query_idx FROM known WHERE is_clean) AND r.query_idx IN (SELECT query_idx FROM scores)
),
drawn_pos AS (
  SELECT s.query_idx, s.pert_idx, 0 AS doc_ord, p.doc_key, p.text, p.score, p.rank, p.robustness
  FROM states s JOIN pos p ON p.query_idx = s.query_idx
   AND p.pick = ({sql_hash('42', 's.query_idx', 's.pert_idx')}) % s.n_pos
  WHERE state = 'kept'
),
drawn_neg AS (
  SELECT n.query_idx, n.pert_idx, row_number() OVER (PARTITION BY n.query_idx, n.pert_idx
           ORDER BY {sql_hash('42', 'n.query_idx', 'n.pert_idx', 'n.doc_key')}, n.doc_key) AS doc_ord,
         n.doc_key, n.text, n.score, n.rank, 0.0 AS robustness
  FROM neg n JOIN states s USING (query_idx, pert_idx) WHERE state = 'kept'
  QUALIFY doc_ord <= {N_NEG}
),
train AS (
  SELECT d.query_idx, d.pert_idx, doc_ord, doc_key, d.text AS document, round(robustness, 4) AS robustness_score,
         robustness AS robustness_raw, score AS retriever_score, rank AS doc_rank, 'listwise+pointwise' AS train_mode,
         CASE WHEN d.pert_idx % 2 = 0 THEN a.question || ' again' ELSE a.question END AS question
  FROM (SELECT * FROM drawn_pos UNION ALL SELECT * FROM drawn_neg) d JOIN asked a USING (query_idx)
)"""
TRAIN = [*SCORED, GROUPS]


def group_parts(spark: SparkSession, folder: str, hot: list | None = None, keep: bool = False):
    """(positives, negatives, states). The scores are written once, all others read them.

    With `keep` so are positives and negatives, for callers that read them again.
    """
    hot = hot_suppliers(spark, folder) if hot is None else hot
    score = settle(scores(spark, folder, hot).select("query_idx", "doc_key", "robustness"))
    clean, perturbed = pool.with_key(clean_list(spark, folder, hot)), pool.with_key(perturbed_list(spark, folder))
    pos, neg = groups.positives(clean, score), groups.hard_negatives(perturbed, score)
    if keep:
        pos, neg = settle(pos), settle(neg)
    records = perturbed.select("query_idx", "pert_idx").distinct()
    return pos, neg, groups.eligibility(records, clean, score, pos, neg, N_NEG)


def training(spark: SparkSession, folder: str) -> DataFrame:
    hot = hot_suppliers(spark, folder)
    pos, neg, states = group_parts(spark, folder, hot, keep=True)
    states = settle(states)
    asks = asked(spark, folder).select("query_idx", "question")
    records = states.select("query_idx", "pert_idx").join(asks, "query_idx").select(
        "query_idx", "pert_idx", "question",
        F.when(F.col("pert_idx") % 2 == 0, F.concat("question", F.lit(" again"))).otherwise("").alias("perturbed_query"),
        F.col("question").alias("clean_question"),
    )
    return groups.training_records(
        groups.draw_positive(states, pos, hot=hot), groups.draw_negatives(states, neg, N_NEG), records
    )


@query("h13_positives", with_ctes(
    "SELECT query_idx, doc_key, rank, round(robustness, 9) AS robustness FROM pos", *TRAIN))
def positives(spark: SparkSession, folder: str) -> DataFrame:
    pos, _, _ = group_parts(spark, folder)
    return pos.select("query_idx", "doc_key", "rank", F.round("robustness", 9).alias("robustness"))


@query("h14_hard_negatives", with_ctes("SELECT query_idx, pert_idx, doc_key, rank FROM neg", *TRAIN))
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    _, neg, _ = group_parts(spark, folder)
    return neg.select("query_idx", F.col("pert_idx").cast("bigint").alias("pert_idx"), "doc_key", "rank")


@query("h15_eligibility", with_ctes("SELECT query_idx, pert_idx, n_pos, n_neg, state FROM states", *TRAIN))
def eligibility(spark: SparkSession, folder: str) -> DataFrame:
    _, _, states = group_parts(spark, folder)
    return states.withColumn("pert_idx", F.col("pert_idx").cast("bigint"))


@query("h15_skip_counters", with_ctes(
    "SELECT count(*) FILTER (state = 'kept') AS n_groups, count(*) FILTER (state = 'no_positive') AS n_skip_no_pos, "
    "count(*) FILTER (state = 'few_negatives') AS n_skip_no_neg FROM states", *TRAIN))
def skip_counters(spark: SparkSession, folder: str) -> DataFrame:
    _, _, states = group_parts(spark, folder)
    return groups.skip_counts(states)


@query("h16_h18_training_records", with_ctes(
    "SELECT query_idx, pert_idx, doc_ord::BIGINT AS doc_ord, doc_key, question, document, robustness_score, "
    "round(robustness_raw, 9) AS robustness_raw, retriever_score, doc_rank, train_mode FROM train", *TRAIN))
def training_records(spark: SparkSession, folder: str) -> DataFrame:
    return training(spark, folder).withColumns({
        "pert_idx": F.col("pert_idx").cast("bigint"), "doc_ord": F.col("doc_ord").cast("bigint"),
        "robustness_raw": F.round("robustness_raw", 9),
    })


@query("h19_nested_groups", with_ctes(
    "SELECT query_idx || '_' || pert_idx AS key, arg_min(question, doc_ord) AS question, any_value(train_mode) AS train_mode, "
    "string_agg(doc_ord || ':' || document || ':' || doc_rank, ',' ORDER BY doc_ord) AS docs FROM train GROUP BY query_idx, pert_idx",
    *TRAIN))
def nested_groups(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.transform(
        "docs",
        lambda d: F.concat_ws(":", d["doc_ord"].cast("string"), d["text"], d["doc_rank"].cast("string")),
    )
    parts = groups.nest_groups(training(spark, folder)).withColumn("docs", F.array_join(shown, ","))
    return parts.groupBy("key").agg(
        F.min_by("question", "part_no").alias("question"), F.min_by("train_mode", "part_no").alias("train_mode"),
        parts_joined("docs"),
    )


# The next ones take every lineitem row as a training record, grouped by order.
RECORDS = """records AS (
  SELECT l_orderkey AS query_idx, (l_linenumber % 3)::BIGINT AS pert_idx, l_partkey AS doc_rank,
         CASE WHEN l_discount >= 0.05 THEN round(l_discount * 10, 4) ELSE 0.0 END AS robustness_score,
         l_suppkey, l_extendedprice
  FROM lineitem
)"""


def plain_records(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_idx"), F.pmod("l_linenumber", F.lit(3)).cast("bigint").alias("pert_idx"),
        F.col("l_partkey").alias("doc_rank"),
        F.when(F.col("l_discount") >= 0.05, F.round(F.col("l_discount") * 10, 4)).otherwise(0.0).alias("robustness_score"),
        "l_suppkey", "l_extendedprice",
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("question"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("document"),
        F.lit("listwise+pointwise").alias("train_mode"),
    )


def ordered(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col(c) for c in ("doc_rank", "l_suppkey", "l_extendedprice")]
    return groups.ordered_records(plain_records(spark, folder), order)


ORDERED = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_idx, pert_idx ORDER BY doc_rank, l_suppkey, l_extendedprice) - 1 AS doc_ord
  FROM records
)"""


@query("h19_groups_of_unordered_records", with_ctes(
    "SELECT query_idx || '_' || pert_idx AS key, 'order ' || query_idx AS question, count(*) AS n_docs, "
    "string_agg('part ' || doc_rank, ',' ORDER BY doc_ord) AS docs FROM ordered GROUP BY query_idx, pert_idx", RECORDS, ORDERED))
def groups_of_unordered(spark: SparkSession, folder: str) -> DataFrame:
    parts = groups.nest_groups(ordered(spark, folder)).select(
        "key", "part_no", "question", F.size("docs").alias("n"),
        F.array_join(F.transform("docs", lambda d: d["text"]), ",").alias("docs"),
    )
    return parts.groupBy("key").agg(
        F.min_by("question", "part_no").alias("question"), F.sum("n").alias("n_docs"), parts_joined("docs")
    )


@query("h20_group_counts", with_ctes(
    "SELECT query_idx || '_' || pert_idx AS key, count(*) FILTER (robustness_score > 0) AS n_pos, "
    "count(*) FILTER (robustness_score = 0) AS n_neg, count(*) AS n_docs FROM records GROUP BY query_idx, pert_idx", RECORDS))
def group_counts(spark: SparkSession, folder: str) -> DataFrame:
    return groups.group_counts(plain_records(spark, folder))


SLICES = """slices AS (
  SELECT query_idx || '_' || pert_idx AS key, ordinal, ordinal % 16 AS slice, n_docs FROM (
    SELECT query_idx, pert_idx, count(*) AS n_docs, row_number() OVER (ORDER BY query_idx, pert_idx) - 1 AS ordinal
    FROM records GROUP BY query_idx, pert_idx)
)"""


@query("h21_round_robin_slices", with_ctes("SELECT key, ordinal, slice, n_docs FROM slices", RECORDS, SLICES))
def round_robin_slices(spark: SparkSession, folder: str) -> DataFrame:
    return groups.slice_groups(plain_records(spark, folder))


@query("h22_manifest", with_ctes(
    "SELECT slice, count(*) AS n_groups, sum(n_docs)::BIGINT AS n_records FROM slices GROUP BY ROLLUP (slice)", RECORDS, SLICES))
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return groups.manifest(groups.slice_groups(plain_records(spark, folder)))


def sql_ids(value: str) -> str:
    return f"list_transform({sql_words(f'lower({value})')}, lambda w: ({sql_hash('w')}) % 31997 + 3)"


# Documents are whole texts; a pair is cut to 512 ids as the feature asks.
ENCODED = f"""tokens AS (
  SELECT doc_id, {sql_ids("'what does ' || source || ' say in ' || lang")} AS q, {sql_ids('text')} AS d FROM documents
),
encoded AS (
  SELECT doc_id, len_q, len_d, [1] || q[1:q_kept] || [2] || d[1:least(len_d, 509 - q_kept)] || [2] AS ids FROM (
    SELECT *, CASE WHEN len_q + len_d <= 509 THEN len_q WHEN len_q <= 255 THEN len_q
                   WHEN len_d <= 254 THEN 509 - len_d ELSE 255 END AS q_kept
    FROM (SELECT *, len(q) AS len_q, len(d) AS len_d FROM tokens))
)"""


def text_records(spark: SparkSession, folder: str) -> DataFrame:
    return spread(given(spark, folder, "documents")).select(
        (F.floor(F.col("doc_id") / 10)).alias("query_idx"), F.lit(0).alias("pert_idx"),
        (F.col("doc_id") % 10).alias("doc_ord"), "doc_id",
        F.concat(F.lit("what does "), "source", F.lit(" say in "), "lang").alias("question"),
        F.col("text").alias("document"),
        F.when(F.col("doc_id") % 10 == 0, 0.6).otherwise(0.0).alias("robustness_score"),
        F.lit("listwise+pointwise").alias("train_mode"),
    )


@query("h23_pair_encoding", with_ctes(
    "SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM encoded", ENCODED))
def pair_encoding(spark: SparkSession, folder: str) -> DataFrame:
    rows = groups.encode_records(text_records(spark, folder))
    return rows.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_ids"),
        F.md5(F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",")).alias("ids_md5"),
    )


@query("h24_masks_and_scores", with_ctes(
    "SELECT doc_id // 10 || '_0' AS key, string_agg(doc_id % 10 = 0, ',' ORDER BY doc_id) AS pos_mask, "
    "string_agg(CASE WHEN doc_id % 10 = 0 THEN 60 ELSE 0 END, ',' ORDER BY doc_id) AS scores_percent, "
    "sum(len(ids))::BIGINT AS n_ids FROM encoded GROUP BY doc_id // 10", ENCODED))
def masks_and_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = groups.encoded_groups(groups.encode_records(text_records(spark, folder)))
    parts = rows.select(
        "key", "part_no",
        F.array_join(F.transform("pos_mask", lambda p: p.cast("string")), ",").alias("pos_mask"),
        F.array_join(F.transform("scores", lambda s: F.round(s * 100).cast("int").cast("string")), ",").alias("scores_percent"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda acc, ids: acc + F.size(ids)).alias("n_ids"),
    )
    return parts.groupBy("key").agg(parts_joined("pos_mask"), parts_joined("scores_percent"), F.sum("n_ids").alias("n_ids"))


@query("h25_group_range", with_ctes(
    "SELECT key, ordinal FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS ordinal FROM slices) "
    "WHERE ordinal >= 100 AND ordinal < 5100", RECORDS, SLICES))
def group_range(spark: SparkSession, folder: str) -> DataFrame:
    counted = groups.group_counts(plain_records(spark, folder))
    return groups.group_range(counted, skip=100, limit=5000).select("key", "ordinal")


@query("h26_encoding_stats", with_ctes(
    "SELECT count(DISTINCT doc_id // 10) AS n_groups, count(*) FILTER (doc_id % 10 = 0) AS n_groups_with_pos, "
    "count(*) AS n_pairs, round(avg(len(ids)), 9) AS mean_length FROM encoded", ENCODED))
def encoding_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = groups.encoded_groups(groups.encode_records(text_records(spark, folder)))
    return groups.encoding_stats(rows).withColumn("mean_length", F.round("mean_length", 9))
