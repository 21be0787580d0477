"""Parquet tables and local exports of hosted question sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

GROUPS_PER_FILE = 8_000


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder with one parquet file or folder per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt out to all cores.

    For tables of a few small files ahead of heavy per-row work. A large table has more
    splits than that and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; only `columns` are read from the files."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_shards(df: DataFrame, path: str, rows_per_file: int = GROUPS_PER_FILE,
                 mode: str = "errorifexists") -> str:
    """Zstd parquet; a file is closed after `rows_per_file` rows."""
    df.write.mode(mode).option("compression", "zstd").option("compressionLevel", "3").option(
        "maxRecordsPerFile", rows_per_file
    ).parquet(path)
    return path


def write_slices(df: DataFrame, path: str, column: str = "slice") -> str:
    """Gzip JSON lines in one folder per slice."""
    df.write.partitionBy(column).option("compression", "gzip").json(path)
    return path


def merge_shards(parts: list[DataFrame]) -> DataFrame:
    """Shards of one keyed table put together; the key keeps their order."""
    return reduce(DataFrame.unionByName, parts)


def census(df: DataFrame) -> DataFrame:
    """Rows per source file. Files without rows are absent."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def census_totals(df: DataFrame) -> DataFrame:
    return census(df).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"))


def export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A local export of a hosted set: parquet by suffix or folder content, else JSON lines."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".gz")):
        return spark.read.schema(schema).json(path)
    return spark.read.parquet(path)


def first_export(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several exports that exists."""
    for path in paths[:-1]:
        if exists(spark, path):
            return export(spark, path, schema)
    return export(spark, paths[-1], schema)


def qa_queries(rows: DataFrame, ordinal: str, source: str) -> DataFrame:
    """QA rows (question, answer) in the form `queryset.answered` takes."""
    return rows.select(
        F.col(ordinal).alias("query_idx"), "question", F.col("answer").alias("answers"), F.lit(source).alias("source")
    )


def truthful_queries(rows: DataFrame, ordinal: str | None = None) -> DataFrame:
    """(query_idx, question, golds): all correct answers, else the best one.

    `ordinal` names the export's id; without one the question is all that tells rows apart.
    """
    golds = F.coalesce("correct_answers", F.array("best_answer")).alias("golds")
    own = [] if ordinal is None else [F.col(ordinal).alias("query_idx")]
    return rows.select(*own, "question", golds)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


ARTICLE, QA, TRUTHFUL = schemas.ARTICLE, schemas.QA, schemas.TRUTHFUL
