"""Scans and sinks: each query writes a given table in one form and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups
from ..session import scratch_path, settle
from ..sources import jsonl, publish, schemas, tables
from ..sources.tables import given
from .catalog import query, with_ctes
from .pool_queries import ENCODED, text_records
from .question_queries import QA, RAW, raw_questions

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOC_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def doc_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("a1_a7_json_lines", DOC_SQL)
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = jsonl.write(given(spark, folder, "documents"), scratch_path(spark, "documents"))
    return doc_rows(jsonl.scan(spark, path, DOC))


@query("a2_a8_gzip_lines", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def gzip_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = jsonl.write(given(spark, folder, "conversations"), scratch_path(spark, "conversations"), compress=True)
    rows = jsonl.scan(spark, f"{path}/*.json.gz", "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("a3_shard_glob", "SELECT doc_id, lang, n_chars FROM documents")
def shard_glob(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "by_lang")
    given(spark, folder, "documents").withColumn("shard", F.col("lang")).write.partitionBy("shard").json(path)
    return jsonl.scan(spark, f"{path}/shard=*/*.json", DOC).select("doc_id", "lang", "n_chars")


@query("a4_pruned_scan", "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey")
def pruned_scan(spark: SparkSession, folder: str) -> DataFrame:
    keys = tables.scan(spark, f"{folder}/orders.parquet", ["o_custkey"])
    return keys.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))


@query("a5_a9_tokenized_shards", with_ctes(
    "SELECT doc_id // 10 || '_0' AS key, count(*) AS n_docs, sum(len(ids))::BIGINT AS n_ids FROM encoded GROUP BY doc_id // 10",
    ENCODED))
def tokenized_shards(spark: SparkSession, folder: str) -> DataFrame:
    encoded = groups.encoded_groups(groups.encode_records(text_records(spark, folder)))
    path = tables.write_shards(encoded, scratch_path(spark, "tokenized"))
    return tables.scan(spark, path).select(
        "key", F.size("pos_mask").cast("bigint").alias("n"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda acc, ids: acc + F.size(ids)).alias("ids"),
    ).groupBy("key").agg(F.sum("n").alias("n_docs"), F.sum("ids").alias("n_ids"))


@query("a6_hosted_exports", with_ctes(
    "SELECT query_idx, question, array_to_string(answers, '|') AS golds, 'nq_open' AS source FROM raw "
    "UNION ALL SELECT query_idx, question, coalesce(array_to_string(all_answers, '|'), correct_answer), 'truthful' FROM qa", RAW, QA))
def hosted_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Local exports of two question sets; the first name of the first one does not exist."""
    raw = raw_questions(spark, folder)
    qa_path = jsonl.write(raw.withColumnRenamed("answers", "answer"), f"{scratch_path(spark, 'qa')}.json")
    rows = tables.first_export(spark, [f"{qa_path}.missing.json", qa_path], f"query_idx bigint, {schemas.QA}")
    qa = tables.qa_queries(rows, "query_idx", "nq_open").select(
        "query_idx", "question", F.array_join("answers", "|").alias("golds"), "source"
    )
    best = raw.where(F.size("answers") > 0).select(
        "query_idx", "question", F.get("answers", 0).alias("best_answer"), F.col("answers").alias("correct_answers")
    )
    best_path = scratch_path(spark, "truthful")
    best.write.parquet(best_path)
    loaded = tables.export(spark, best_path, schemas.TRUTHFUL)
    golds = F.array_join("golds", "|").alias("golds")
    truthful = tables.truthful_queries(loaded, "query_idx").select("query_idx", "question", golds, F.lit("truthful").alias("source"))
    return qa.unionByName(truthful)


@query("a9_a16_shard_census",
       "SELECT count(*) AS n_rows, true AS within_limit, count(*) >= 1 AS has_files FROM lineitem")
def shard_census(spark: SparkSession, folder: str) -> DataFrame:
    path = tables.write_shards(given(spark, folder, "lineitem"), scratch_path(spark, "lineitem"))
    return tables.census(spark.read.parquet(path)).agg(
        F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= tables.GROUPS_PER_FILE).alias("within_limit"),
        (F.count(F.lit(1)) >= 1).alias("has_files"),
    )


@query("a10_verified_publish", "SELECT l_linestatus, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def verified_publish(spark: SparkSession, folder: str) -> DataFrame:
    table = publish.publish(given(spark, folder, "lineitem"), scratch_path(spark, "published"))
    return table.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query("a10_failed_publish", """
SELECT l_returnflag, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1
UNION ALL SELECT 'failed', count(*), 0.0 FROM lineitem WHERE l_returnflag = 'R'""")
def failed_publish(spark: SparkSession, folder: str) -> DataFrame:
    """A table that a failed replacement leaves alone (counted as it stood then), and that grows by an append."""
    items, path = given(spark, folder, "lineitem"), scratch_path(spark, "published")
    publish.publish(items.where("l_returnflag = 'R'"), path)

    def no_returns(staged: DataFrame) -> None:
        if not staged.where("l_returnflag = 'N'").isEmpty():
            raise ValueError("not returned")

    try:
        publish.publish(items, path, "overwrite", no_returns)
        raise AssertionError("the check let the table pass")
    except ValueError:
        left = settle(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")))
    table = publish.publish(items.where("l_returnflag = 'A'"), path, "append", no_returns)
    sums = table.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return sums.unionByName(left.select(F.lit("failed").alias("l_returnflag"), "n_rows", F.lit(0.0).alias("price")))


@query("a11_remaining_work",
       "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remaining_work(spark: SparkSession, folder: str) -> DataFrame:
    done = given(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return publish.remaining(given(spark, folder, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("a12_cut_off_lines",
       "SELECT CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n_lines FROM documents "
       "LEFT JOIN labels USING (doc_id) GROUP BY 1")
def cut_off_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of documents labelled toxic are cut in half before they are read."""
    labels = given(spark, folder, "labels").select("doc_id", "toxic")
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    whole = given(spark, folder, "documents").join(labels, "doc_id", "left").select(line.alias("line"), "toxic")
    half = F.expr("substring(line, 1, cast(length(line) / 2 as int))")
    path = scratch_path(spark, "cut")
    whole.select(F.when(F.col("toxic") == 1, half).otherwise(F.col("line")).alias("value")).write.text(path)
    good, bad = jsonl.scan_tolerant(spark, path, "doc_id bigint, text string, lang string")
    return good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n_lines")).unionByName(
        bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("n_lines"))
    ).where("n_lines > 0")


@query("a13_reused_table", "SELECT l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY l_suppkey")
def reused_table(spark: SparkSession, folder: str) -> DataFrame:
    """The second call must read what the first one wrote; its own builder would fail."""
    path = scratch_path(spark, "scored")
    counted = given(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"))
    publish.reuse_or_build(spark, path, lambda: counted)

    def never() -> DataFrame:
        raise AssertionError("the table was there")

    return publish.reuse_or_build(spark, path, never)


@query("a14_merged_embeddings",
       "SELECT vec_id, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings")
def merged_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = given(spark, folder, "embeddings")
    parts = []
    for name, wanted in (("low", F.col("label") < 5), ("high", F.col("label") >= 5)):
        path = scratch_path(spark, name)
        rows.where(wanted).write.parquet(path)
        parts.append(spark.read.parquet(path))
    return tables.merge_shards(parts).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"),
    )


@query("a15_report", "SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1, 2")
def report(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "report")
    metrics = given(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity")
    )
    publish.write_report(metrics, path)
    return spark.read.schema(metrics.schema).json(publish.write_report(metrics, path))
