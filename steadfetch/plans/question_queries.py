"""Question preparation and rewrites over the part table."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions.fixed import HEDGE_WORDS, TOPICS
from ..functions.hashing import stable_hash
from ..operators import inference, queryset, rewrites
from ..session import settle
from ..sources.tables import given, spread
from .catalog import query, sql_hash, sql_text, with_ctes

RAW = """raw AS (
  SELECT p_partkey AS query_idx, 'what is part number ' || p_partkey AS question,
         CASE WHEN p_size = 50 THEN []::VARCHAR[]
              WHEN p_type = 'PROMO' THEN [p_brand, upper(p_name)]
              ELSE [upper(p_name), p_brand] END AS answers
  FROM part
)"""
QA = """qa AS (
  SELECT query_idx, question, answers[1] AS correct_answer, answers AS all_answers FROM raw WHERE len(answers) > 0
)"""


def raw_questions(spark: SparkSession, folder: str) -> DataFrame:
    name = F.upper("p_name")
    answers = (
        F.when(F.col("p_size") == 50, F.array().cast("array<string>"))
        .when(F.col("p_type") == "PROMO", F.array(F.col("p_brand"), name))
        .otherwise(F.array(name, F.col("p_brand")))
    )
    return spread(given(spark, folder, "part")).select(
        F.col("p_partkey").alias("query_idx"),
        F.concat(F.lit("what is part number "), F.col("p_partkey").cast("string")).alias("question"),
        answers.alias("answers"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return queryset.answered(raw_questions(spark, folder))


@query("c1_c2_answered_queries", with_ctes(
    "SELECT query_idx, question, correct_answer, array_to_string(all_answers, '|') AS all_answers FROM qa", RAW, QA))
def answered_queries(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).withColumn("all_answers", F.array_join("all_answers", "|"))


@query("c3_shuffled_cap", with_ctes(
    f"SELECT row_number() OVER (ORDER BY {sql_hash('42', 'query_idx')}, query_idx) - 1 AS query_idx, "
    f"query_idx AS source_idx, question FROM qa ORDER BY {sql_hash('42', 'query_idx')}, 2 LIMIT 10000".replace(
        "ORDER BY ('0x' || substr(md5(concat_ws('|', 42, query_idx)), 1, 8))::BIGINT, 2 LIMIT",
        "ORDER BY 1 LIMIT"), RAW, QA))
def shuffled_cap(spark: SparkSession, folder: str) -> DataFrame:
    return queryset.shuffled_cap(questions(spark, folder)).select("query_idx", "source_idx", "question")


@query("c4_first_queries", with_ctes(
    "SELECT query_idx, question, correct_answer FROM qa ORDER BY query_idx LIMIT 1000", RAW, QA))
def first_queries(spark: SparkSession, folder: str) -> DataFrame:
    return queryset.first_queries(questions(spark, folder), 1000).select("query_idx", "question", "correct_answer")


def sql_entity(value: str) -> str:
    bare = f"trim({value}, ' ' || chr(9) || chr(10) || chr(13))"
    return (
        f"(length({bare}) BETWEEN 3 AND 40 AND regexp_matches({bare}, '^[A-Z]') "
        f"AND regexp_full_match({bare}, '[A-Za-z''\\-. ]+') AND len(string_split_regex({bare}, ' +')) <= 5)"
    )


NAMES = """names AS (
  SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part
  UNION ALL SELECT 'brand', p_partkey, p_brand FROM part
  UNION ALL SELECT 'type', p_partkey, ' ' || p_type || ' ' FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
  UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
  UNION ALL SELECT 'document', doc_id, string_split(text, '.')[1] FROM documents
)"""


@query("c5_entity_like", with_ctes(
    f"SELECT kind, id, {sql_entity('name')} AS is_entity FROM names", NAMES))
def entity_like(spark: SparkSession, folder: str) -> DataFrame:
    def names(table: str, key: str, name: Column, kind: str) -> DataFrame:
        return given(spark, folder, table).select(
            F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), name.alias("name")
        )

    rows = names("part", "p_partkey", F.col("p_name"), "part")
    for more in (
        names("part", "p_partkey", F.col("p_brand"), "brand"),
        names("part", "p_partkey", F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), "type"),
        names("customer", "c_custkey", F.col("c_name"), "customer"),
        names("nation", "n_nationkey", F.col("n_name"), "nation"),
        names("documents", "doc_id", F.get(F.split("text", "\\."), 0), "document"),
    ):
        rows = rows.unionByName(more)
    return rows.select("kind", "id", text.entity_like(F.col("name")).alias("is_entity"))


POOL = f"pool AS (SELECT DISTINCT correct_answer AS belief FROM qa WHERE {sql_entity('correct_answer')})"


@query("c6_belief_pool", with_ctes("SELECT belief FROM pool", RAW, QA, POOL))
def belief_pool(spark: SparkSession, folder: str) -> DataFrame:
    return queryset.belief_pool(questions(spark, folder))


# Draws without replacement, as in operators.queryset.sample_beliefs: k is 2 or 3.
def beliefs_sql(k: int, pad: bool) -> list[str]:
    h = [sql_hash("42", "query_idx", str(j)) for j in range(k)]
    cols = ", ".join(
        f"CASE WHEN free > {j} THEN ({h[j]}) % greatest(free - {j}, 1) END AS r{j}" for j in range(k)
    )
    steps = ["SELECT *, r0 AS d0 FROM drawn0", "SELECT *, r1 + (CASE WHEN r1 >= d0 THEN 1 ELSE 0 END) AS d1 FROM s0"]
    if k == 3:
        steps.append(
            "SELECT *, CASE WHEN r2 + (CASE WHEN r2 >= least(d0, d1) THEN 1 ELSE 0 END) >= greatest(d0, d1) "
            "THEN r2 + (CASE WHEN r2 >= least(d0, d1) THEN 1 ELSE 0 END) + 1 "
            "ELSE r2 + (CASE WHEN r2 >= least(d0, d1) THEN 1 ELSE 0 END) END AS d2 FROM s1"
        )
    ctes = [
        "numbered AS (SELECT belief, lower(belief) AS low, row_number() OVER (ORDER BY lower(belief), belief) - 1 AS pos FROM pool)",
        "own AS (SELECT low, min(pos) AS start, count(*) AS run FROM numbered GROUP BY low)",
        f"drawn0 AS (SELECT *, {cols} FROM (SELECT qa.query_idx, own.start, coalesce(own.run, 0) AS run, "
        "(SELECT count(*) FROM pool) - coalesce(own.run, 0) AS free FROM qa LEFT JOIN own ON lower(qa.correct_answer) = own.low))",
    ]
    ctes += [f"s{i} AS ({s})" for i, s in enumerate(steps)]
    last = f"s{k - 1}"
    picks = " UNION ALL ".join(
        f"SELECT query_idx, {j} AS j, d{j} + (CASE WHEN d{j} >= start THEN run ELSE 0 END) AS pos FROM {last}"
        for j in range(k)
    )
    missing = "'Unknown'" if pad else "NULL"
    ctes += [
        f"picks AS ({picks})",
        f"drawn AS (SELECT query_idx, j, coalesce(belief, {missing}) AS belief FROM picks LEFT JOIN numbered USING (pos))",
    ]
    return ctes


@query("c7_sampled_beliefs", with_ctes(
    "SELECT query_idx, string_agg(belief, '|' ORDER BY j) AS beliefs FROM drawn GROUP BY query_idx",
    RAW, QA, POOL, *beliefs_sql(2, True)))
def sampled_beliefs(spark: SparkSession, folder: str) -> DataFrame:
    qa = questions(spark, folder)
    drawn = queryset.sample_beliefs(qa, queryset.belief_pool(qa))
    return drawn.select("query_idx", F.array_join("beliefs", "|").alias("beliefs"))


@query("c7_sampled_beliefs_three", with_ctes(
    "SELECT query_idx, coalesce(string_agg(belief, '|' ORDER BY j), 'Unknown') AS beliefs FROM drawn GROUP BY query_idx",
    RAW, QA, POOL, *beliefs_sql(3, False)))
def sampled_beliefs_three(spark: SparkSession, folder: str) -> DataFrame:
    qa = questions(spark, folder)
    drawn = queryset.sample_beliefs(qa, queryset.belief_pool(qa), k=3, pad=False)
    return drawn.select("query_idx", F.array_join("beliefs", "|").alias("beliefs"))


SLOTS = """patterns AS (SELECT [[1, 2, 3, 1, 2], [2, 3, 1, 2, 3], [3, 1, 2, 3, 1]] AS p),
slots AS (
  SELECT qa.*, s AS slot_idx, p[query_idx % 3 + 1][s + 1] AS ptype,
         len(list_filter(p[query_idx % 3 + 1][1 : s + 1], lambda t: t = p[query_idx % 3 + 1][s + 1])) - 1 AS nth
  FROM qa, patterns, unnest(range(5)) AS r(s)
)"""


@query("c8_slot_plan", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, ptype::BIGINT AS ptype, nth::BIGINT AS nth FROM slots", RAW, QA, SLOTS))
def slot_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = queryset.plan_slots(questions(spark, folder))
    return rows.select("query_idx", *[F.col(c).cast("bigint").alias(c) for c in ("slot_idx", "ptype", "nth")])


def sql_topic(*parts: str) -> str:
    listed = ", ".join(sql_text(t) for t in TOPICS)
    return f"([{listed}])[({sql_hash(*parts)}) % {len(TOPICS)} + 1]"


TASKS = [
    RAW, QA, POOL, *beliefs_sql(2, True), SLOTS,
    f"""tasks AS (
  SELECT s.query_idx, slot_idx, ptype, question, correct_answer, all_answers,
         CASE WHEN ptype = 1 THEN d.belief END AS wa,
         CASE WHEN ptype = 2 THEN CASE WHEN nth % 2 = 0 THEN 'A' ELSE 'B' END END AS t2_variant,
         CASE WHEN ptype = 3 THEN {sql_topic('42', 's.query_idx', 'slot_idx')} END AS topic
  FROM slots s LEFT JOIN drawn d ON d.query_idx = s.query_idx AND d.j = s.nth % 2
)""",
]


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    qa = questions(spark, folder)
    return queryset.slot_tasks(queryset.sample_beliefs(qa, queryset.belief_pool(qa)))


@query("c9_c10_slot_tasks", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, ptype::BIGINT AS ptype, wa, t2_variant, topic FROM tasks", *TASKS))
def slot_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return tasks(spark, folder).select(
        "query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"),
        F.col("ptype").cast("bigint").alias("ptype"), "wa", "t2_variant", "topic",
    )


def sql_fill(template: str, avoid: str = "correct_answer") -> str:
    out = sql_text(template)
    for name, value in (("q", "question"), ("avoid", avoid), ("wa", "coalesce(wa, '')"), ("topic", "coalesce(topic, '')")):
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


SQL_PROMPT = (
    f"CASE WHEN ptype = 1 THEN {sql_fill(prompts.FALSE_PREMISE)} "
    f"WHEN ptype = 2 AND t2_variant = 'A' THEN {sql_fill(prompts.FALSE_HISTORY)} "
    f"WHEN ptype = 2 THEN {sql_fill(prompts.FALSE_QUANTITY)} ELSE {sql_fill(prompts.DISTRACTION)} END"
)


@query("c11_prompts", with_ctes(
    f"SELECT query_idx, slot_idx::BIGINT AS slot_idx, 'system,user' AS roles, md5({SQL_PROMPT}) AS prompt_md5 FROM tasks", *TASKS))
def prompt_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = queryset.with_prompts(tasks(spark, folder))
    return rows.select(
        "query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"),
        F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.element_at("prompt", -1)["content"]).alias("prompt_md5"),
    )


@query("c12_dataset_pick",
       "SELECT l_returnflag AS dataset, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_queries "
       "FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def dataset_pick(spark: SparkSession, folder: str) -> DataFrame:
    rows = given(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), "l_orderkey"
    )
    return queryset.with_datasets(rows, ["A", "R"]).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_orderkey").alias("n_queries")
    )


# ---- Rewrites. A stand-in generator gives good, leaking, hedged and unchanged texts by hash.

def stand_in_text(kind: Column, topic: Column) -> Column:
    """One answer of the stand-in generator as a column."""
    q, label = F.col("question"), F.lit("\n Rewritten: ")
    good = (
        F.when(F.col("ptype") == 1, F.concat(F.lit("Since "), F.col("wa"), F.lit(" took it over long ago, "), q))
        .when(F.col("ptype") == 2, F.concat(F.lit("Since the old catalogue closed years ago, "), q))
        .otherwise(F.concat(F.lit("The history of "), topic, F.lit(" fills many books.")))
    )
    body = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("People say that "), F.col("correct_answer"), F.lit(" is near, "), q))
        .when(kind == 2, F.concat(F.lit("Although others supposedly ran the old business then, "), q))
        .otherwise(q)
    )
    return F.concat(label, body, F.lit("\n\nA further line."))


# What the stand-in reads of a task; nothing else goes to Python.
READ = ["query_idx", "slot_idx", "attempt", "ptype", "wa", "question", "asked_topic", "correct_answer"]


def stand_in_generator(batch: pd.DataFrame) -> pd.Series:
    """The same as a batch function, reading the task's columns."""
    def one(row) -> str:
        seed = f"{row.query_idx}|{row.slot_idx}|{row.attempt}"
        kind = int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % 4
        if kind == 0 and row.ptype == 1:
            body = f"Since {row.wa} took it over long ago, {row.question}"
        elif kind == 0 and row.ptype == 2:
            body = f"Since the old catalogue closed years ago, {row.question}"
        elif kind == 0:
            body = f"The history of {row.asked_topic} fills many books."
        elif kind == 1:
            body = f"People say that {row.correct_answer} is near, {row.question}"
        elif kind == 2:
            body = f"Although others supposedly ran the old business then, {row.question}"
        else:
            body = row.question
        return f"\n Rewritten: {body}\n\nA further line."

    return pd.Series([one(r) for r in batch.itertuples(index=False)])


def sql_body(kind: str, topic: str) -> str:
    return (
        f"CASE WHEN {kind} = 0 AND ptype = 1 THEN 'Since ' || wa || ' took it over long ago, ' || question "
        f"WHEN {kind} = 0 AND ptype = 2 THEN 'Since the old catalogue closed years ago, ' || question "
        f"WHEN {kind} = 0 THEN 'The history of ' || {topic} || ' fills many books.' "
        f"WHEN {kind} = 1 THEN 'People say that ' || correct_answer || ' is near, ' || question "
        f"WHEN {kind} = 2 THEN 'Although others supposedly ran the old business then, ' || question "
        "ELSE question END"
    )


def sql_norm(value: str) -> str:
    return f"trim(regexp_replace(lower({value}), '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(value: str) -> str:
    return f"string_split({sql_norm(value)}, ' ')"


SQL_LEAK = (
    "len(list_filter(all_answers, lambda a: length(trim(a)) >= 3 AND contains(lower(output), lower(trim(a))))) > 0"
)
SQL_HEDGE = f"regexp_matches(lower(output), '\\b({'|'.join(HEDGE_WORDS)})\\b')"
SQL_NEW = (
    f"len(list_filter({sql_tokens('output')}, lambda t: length(t) >= 3 AND NOT list_contains({sql_tokens('question')}, t)))"
)
SQL_BELIEF = (
    f"(len(list_filter({sql_tokens('wa')}, lambda t: length(t) >= 2)) > 0 AND "
    f"len(list_filter({sql_tokens('wa')}, lambda t: length(t) >= 2 AND NOT list_contains({sql_tokens('output')}, t))) = 0)"
)
SQL_VALID = (
    f"(output <> '' AND NOT ({SQL_LEAK}) AND CASE WHEN ptype = 3 THEN true "
    f"WHEN ptype = 1 THEN NOT {SQL_HEDGE} AND {SQL_NEW} >= 4 AND {SQL_BELIEF} "
    f"ELSE NOT {SQL_HEDGE} AND {SQL_NEW} >= 4 END)"
)

ATTEMPTS = [
    *TASKS,
    f"""asked AS (
  SELECT t.*, a AS attempt, ({sql_hash('query_idx', 'slot_idx', 'a')}) % 4 AS kind,
         CASE WHEN ptype = 3 THEN CASE WHEN a = 0 THEN topic ELSE {sql_topic('42', 'query_idx', 'slot_idx', 'a')} END END AS asked_topic
  FROM tasks t, unnest(range(5)) AS r(a)
),
outputs AS (SELECT *, {sql_body('kind', 'asked_topic')} AS output FROM asked),
checked AS (SELECT *, {SQL_VALID} AS ok FROM outputs),
first_ok AS (
  SELECT query_idx, slot_idx, min(attempt) AS attempt, arg_min(output, attempt) AS output
  FROM checked WHERE ok GROUP BY query_idx, slot_idx
),
generated AS (
  SELECT t.*, coalesce(f.attempt, 5) AS attempt, f.output, f.output IS NULL AS is_fallback
  FROM tasks t LEFT JOIN first_ok f USING (query_idx, slot_idx)
)""",
]


def generated(spark: SparkSession, folder: str) -> DataFrame:
    return rewrites.generate(tasks(spark, folder), stand_in_generator, inputs=READ)


@query("d1_d2_generation_rounds", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, attempt::BIGINT AS attempt, is_fallback, output FROM generated", *ATTEMPTS))
def generation_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return generated(spark, folder).select(
        "query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"),
        F.col("attempt").cast("bigint").alias("attempt"), "is_fallback", "output",
    )


@query("d2_failed_calls", """
SELECT 'picky' AS model, count(*) FILTER (doc_id % 50 <> 7) AS n_answered, count(*) FILTER (doc_id % 50 = 7) AS n_failed FROM documents
UNION ALL SELECT 'down', 0, count(*) FROM documents
UNION ALL SELECT 'resumed', count(*), 0 FROM documents""")
def failed_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A model that fails for some rows, one that fails for all, and the second run resumed with the first one mended."""
    asked = given(spark, folder, "documents").select("doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("prompt"))

    def mended(batch: pd.DataFrame) -> pd.Series:
        return batch["prompt"].str.upper()

    def picky(batch: pd.DataFrame) -> pd.Series:
        if (batch["doc_id"] % 50 == 7).any():
            raise ConnectionError("refused")
        return mended(batch)

    def down(batch: pd.DataFrame) -> pd.Series:
        raise TimeoutError("no reply")

    how = {"inputs": ["doc_id", "prompt"], "pause": 0.0}
    runs = {"picky": settle(inference.call_batches(asked, picky, "call", **how)), "down": settle(inference.call_batches(asked, down, "call", **how))}
    runs["resumed"] = settle(inference.resume(runs["down"], mended, "call", **how))
    right = F.col("call.answer") == F.upper("prompt")
    counts = [
        rows.agg(F.lit(name).alias("model"), F.count_if(right).alias("n_answered"), F.count("call.error").alias("n_failed"))
        for name, rows in runs.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# First answers only, as columns: the text rules below need no model call.
FIRST = [*TASKS, f"""outputs AS (
  SELECT *, {sql_body('kind', 'topic')} AS output
  FROM (SELECT *, ({sql_hash('query_idx', 'slot_idx', '0')}) % 4 AS kind FROM tasks)
)"""]


def first_outputs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.pmod(stable_hash(F.col("query_idx"), F.col("slot_idx"), 0), F.lit(4))
    return tasks(spark, folder).withColumn("kind", kind).withColumn(
        "raw", stand_in_text(F.col("kind"), F.col("topic"))
    ).withColumn("output", text.clean_output(F.col("raw")))


def long_slot(*rest: str) -> list:
    return ["query_idx", F.col("slot_idx").cast("bigint").alias("slot_idx"), *rest]


@query("e1_clean_output", with_ctes("SELECT query_idx, slot_idx::BIGINT AS slot_idx, output FROM outputs", *FIRST))
def clean_output(spark: SparkSession, folder: str) -> DataFrame:
    return first_outputs(spark, folder).select(*long_slot("output"))


THINK = """thought AS (
  SELECT conv_id, turn, text, CASE (conv_id + turn) % 4
    WHEN 0 THEN '<think>' || text || '</think>' || chr(10) || 'Answer ' || turn
    WHEN 1 THEN text || '</think> Answer ' || turn
    WHEN 2 THEN '<think>' || text
    ELSE text END AS raw
  FROM conversations
)"""


def thoughts(spark: SparkSession, folder: str) -> DataFrame:
    place = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    raw = (
        F.when(place == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>\nAnswer "), F.col("turn").cast("string")))
        .when(place == 1, F.concat("text", F.lit("</think> Answer "), F.col("turn").cast("string")))
        .when(place == 2, F.concat(F.lit("<think>"), "text"))
        .otherwise(F.col("text"))
    )
    return given(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))


@query("e2_strip_reasoning", with_ctes(
    "SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'Answer ' || turn WHEN 1 THEN 'Answer ' || turn "
    "WHEN 2 THEN '' ELSE coalesce(list_filter(list_transform(string_split_regex(raw, '[\\n\\r]+'), lambda x: trim(x)), "
    "lambda x: x <> '')[1], trim(raw)) END AS answer FROM thought", THINK))
def strip_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    return thoughts(spark, folder).select("conv_id", "turn", text.strip_reasoning_block(F.col("raw")).alias("answer"))


@query("e3_e7_text_rules", with_ctes(
    f"SELECT query_idx, slot_idx::BIGINT AS slot_idx, {SQL_LEAK} AS leaks, {SQL_HEDGE} AS is_hedged, "
    f"{sql_norm('output')} AS norm, coalesce({SQL_BELIEF}, false) AS holds_belief, {SQL_NEW}::BIGINT AS n_new, "
    f"{SQL_NEW} < 4 AS too_similar FROM outputs", *FIRST))
def text_rules(spark: SparkSession, folder: str) -> DataFrame:
    out, q = F.col("output"), F.col("question")
    return first_outputs(spark, folder).select(
        *long_slot(),
        text.leaks(out, F.col("all_answers")).alias("leaks"),
        text.is_hedged(out).alias("is_hedged"),
        text.simple_norm(out).alias("norm"),
        F.coalesce(text.holds_belief(out, F.col("wa")), F.lit(False)).alias("holds_belief"),
        text.new_token_count(out, q).cast("bigint").alias("n_new"),
        text.too_similar(out, q).alias("too_similar"),
    )


@query("e8_valid_rewrite", with_ctes(
    f"SELECT query_idx, slot_idx::BIGINT AS slot_idx, {SQL_VALID} AS is_valid FROM outputs", *FIRST))
def valid_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    ok = text.is_valid_rewrite(
        F.col("output"), F.col("ptype"), F.col("question"), F.col("wa"), F.col("all_answers")
    )
    return first_outputs(spark, folder).select(*long_slot(), ok.alias("is_valid"))


@query("e9_filtered_rewrites", with_ctes(
    f"SELECT query_idx, slot_idx::BIGINT AS slot_idx, output FROM outputs WHERE {SQL_VALID}", *FIRST))
def filtered_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    return rewrites.filtered(first_outputs(spark, folder)).select(*long_slot("output"))


# Invalid first answers count as empty here, as if every later round had failed too.
ASSEMBLED = [*FIRST, f"""final AS (SELECT *, CASE WHEN {SQL_VALID} THEN output ELSE '' END AS o FROM outputs),
closed AS (
  SELECT *, CASE WHEN ptype = 3 THEN CASE WHEN o <> '' THEN question || ' ' || o ELSE question END
                 ELSE CASE WHEN regexp_matches(CASE WHEN o <> '' THEN trim(o) ELSE question END, '[?.!]$')
                           THEN CASE WHEN o <> '' THEN trim(o) ELSE question END
                           ELSE (CASE WHEN o <> '' THEN trim(o) ELSE question END) || '?' END END AS perturbed_query
  FROM final
),
flat AS (
  SELECT query_idx, slot_idx, question, correct_answer, all_answers, ptype AS perturbation_type,
         CASE WHEN ptype = 3 THEN o ELSE perturbed_query END AS perturbation_text, perturbed_query,
         wa AS wrong_belief, t2_variant, topic, o = '' AS is_empty
  FROM closed
)"""]


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    ok = text.is_valid_rewrite(
        F.col("output"), F.col("ptype"), F.col("question"), F.col("wa"), F.col("all_answers")
    )
    rows = first_outputs(spark, folder).withColumn("output", F.when(ok, F.col("output")))
    return rewrites.assemble(rows)


@query("e10_e11_assembled", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, perturbation_type::BIGINT AS perturbation_type, "
    "perturbation_text, perturbed_query, wrong_belief, t2_variant, topic FROM flat", *ASSEMBLED))
def assembled_rows(spark: SparkSession, folder: str) -> DataFrame:
    return assembled(spark, folder).select(
        *long_slot(), F.col("perturbation_type").cast("bigint").alias("perturbation_type"),
        "perturbation_text", "perturbed_query", "wrong_belief", "t2_variant", "topic",
    )


@query("e10_noted_distraction", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS slot_idx, CASE WHEN o = '' THEN question WHEN ptype = 3 "
    "THEN question || ' [Note]: ' || o ELSE o END AS perturbed_query, o AS perturbation_text FROM final", *ASSEMBLED))
def noted_distraction(spark: SparkSession, folder: str) -> DataFrame:
    ok = text.is_valid_rewrite(
        F.col("output"), F.col("ptype"), F.col("question"), F.col("wa"), F.col("all_answers")
    )
    rows = first_outputs(spark, folder).withColumn("output", F.when(ok, F.col("output")))
    return rewrites.assemble(rows, note_prefix="[Note]:", end_mark=False).select(
        *long_slot("perturbed_query", "perturbation_text")
    )


@query("e12_nested_rewrites", with_ctes(
    "SELECT query_idx, count(*) AS n_slots, string_agg(perturbation_type || ':' || perturbed_query, '|' ORDER BY slot_idx) "
    "AS rewrites FROM flat GROUP BY query_idx", *ASSEMBLED))
def nested_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    nested = rewrites.nest(assembled(spark, folder))
    shown = F.transform(
        "perturbations", lambda p: F.concat_ws(":", p["perturbation_type"].cast("string"), p["perturbed_query"])
    )
    return nested.select(
        "query_idx", F.size("perturbations").cast("bigint").alias("n_slots"), F.array_join(shown, "|").alias("rewrites")
    )


@query("e13_flattened_rewrites", with_ctes(
    "SELECT query_idx, slot_idx::BIGINT AS pert_idx, perturbation_type::BIGINT AS perturbation_type, perturbed_query FROM flat", *ASSEMBLED))
def flattened_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    flat = rewrites.flatten(rewrites.nest(assembled(spark, folder)))
    return flat.select(
        "query_idx", F.col("pert_idx").cast("bigint").alias("pert_idx"),
        F.col("perturbation_type").cast("bigint").alias("perturbation_type"), "perturbed_query",
    )


# Counted on the unchecked answers, which do leak.
@query("e14_quality_counters", with_ctes(
    "SELECT count(*) AS n_rows, count(*) FILTER (testable) AS n_testable, "
    "count(*) FILTER (testable AND regexp_matches(lower(output), '\\b' || regexp_escape(lower(correct_answer)) || '\\b')) AS n_leaks, "
    "count(*) FILTER (output = '') AS n_empty, 0::BIGINT AS n_fallback, count(*) FILTER (ptype <> 3 AND output = question) AS n_as_question "
    "FROM (SELECT *, length(correct_answer) > 3 AND NOT contains(lower(question), lower(correct_answer)) AS testable FROM outputs)",
    *FIRST))
def quality_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = rewrites.assemble(first_outputs(spark, folder), end_mark=False)
    return rewrites.quality(rows)


# The generator that always leaks when a slot's third digit is 0: its tasks fall back after all rounds.
@query("e14_fallbacks", with_ctes(
    "SELECT ptype::BIGINT AS perturbation_type, count(*) AS n_rows, count(*) FILTER (is_fallback OR stubborn) AS n_fallback, "
    "count(*) FILTER (is_fallback OR stubborn OR output = '') AS n_empty FROM "
    "(SELECT *, query_idx % 10 = 3 AS stubborn FROM generated) GROUP BY ptype", *ATTEMPTS))
def fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """Counters per type, with a generator that never answers every tenth question."""
    def silent(batch: pd.DataFrame) -> pd.Series:
        said = stand_in_generator(batch)
        return said.where((batch["query_idx"] % 10 != 3).to_numpy(), None)

    # The rounds are written already, and the counters read few of their columns.
    rows = rewrites.assemble(rewrites.generate(tasks(spark, folder), silent, inputs=READ), end_mark=False)
    parts = [
        rewrites.quality(rows.where(F.col("perturbation_type") == t)).select(F.lit(t).cast("bigint").alias("perturbation_type"), "n_rows", "n_fallback", "n_empty")
        for t in (1, 2, 3)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("e15_balanced_test_queries", with_ctes(
    "SELECT query_idx, coalesce(min(CASE WHEN perturbation_type = 1 + query_idx % 3 THEN perturbed_query END) FILTER "
    "(slot_idx = first_slot), arg_min(perturbed_query, slot_idx)) AS query FROM (SELECT *, min(CASE WHEN "
    "perturbation_type = 1 + query_idx % 3 THEN slot_idx END) OVER (PARTITION BY query_idx) AS first_slot FROM flat) "
    "GROUP BY query_idx", *ASSEMBLED))
def balanced_test_queries(spark: SparkSession, folder: str) -> DataFrame:
    return rewrites.test_queries(rewrites.nest(assembled(spark, folder))).select("query_idx", "query")
