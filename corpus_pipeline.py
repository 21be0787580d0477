"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfetch.llm import mixing, neardup, packing, pii, quality
from steadfetch.llm.queries import source_weights, tokenizer_path
from steadfetch.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(judged: DataFrame, text, *more: str) -> DataFrame:
    """The columns of documents with another text; n_chars follows it."""
    out = judged.withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), *more)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their source's frequent lines.

    Verdicts are written first: a filter on them would be moved below the array columns they are
    made of, and those would be built anew for every element.
    """
    return settle(_with_text(quality.judge(docs), F.col("clean_text"), "kept")).where("kept").drop("kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one that stands for it."""
    return neardup.representatives(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    found = pii.find(docs)
    return _with_text(found, pii.redacted(F.col("text"), F.col("spans")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn copies, in the shards' order; a copy that the target cuts stays if half of it is drawn."""
    sized = docs.withColumn("size", F.size(quality.words(F.col("text"))).cast("bigint"))
    drawn = mixing.materialise(mixing.mix(sized, source_weights(docs)))
    return drawn.where(F.col("words") * 2 >= F.col("size")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids, and their places in sequences."""
    pieces = packing.tokenise(docs, tokenizer_path())
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("quality_rules", apply_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# Tokens, probabilistic signatures and the bootstrapped patterns have no SQL; tests run the stages
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
