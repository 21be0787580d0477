"""Corpus preparation: articles to numbered, encoded passages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.fixed import CHUNK_WORDS, MIN_CHUNK_WORDS
from ..functions.text import has_words, squeeze, word_runs, words
from ..session import settle
from .ordinal import running_start


def first_articles(articles: DataFrame, n: int) -> DataFrame:
    """The first n articles by id."""
    return articles.orderBy("article_id").limit(n)


def chunk(articles: DataFrame, size: int = CHUNK_WORDS, min_words: int = MIN_CHUNK_WORDS) -> DataFrame:
    """Cuts each article into runs of `size` words; a last run under `min_words` is dropped."""
    keep = [c for c in articles.columns if c != "text"]
    runs = articles.select(*keep, F.posexplode(word_runs(F.col("text"), size)).alias("chunk_no", "_run"))
    spaces = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "), F.lit("")))
    return (
        runs.where(has_words(F.col("_run"), min_words))
        .withColumn("chunk", squeeze(F.col("_run")))
        .withColumn("n_words", spaces + 1)
        .drop("_run")
    )


def titled(chunks: DataFrame) -> DataFrame:
    """Adds the passage text `title: chunk`."""
    title = F.coalesce(F.col("title"), F.lit(""))
    return chunks.withColumn("text", F.concat(title, F.lit(": "), F.col("chunk")))


def kept_chunks(text: Column, size: int = CHUNK_WORDS, min_words: int = MIN_CHUNK_WORDS) -> Column:
    """How many passages an article gives."""
    return F.size(F.filter(word_runs(text, size), lambda run: has_words(run, min_words))).cast("bigint")


def numbered_passages(
    articles: DataFrame, size: int = CHUNK_WORDS, min_words: int = MIN_CHUNK_WORDS
) -> DataFrame:
    """Passages with their dense id in (article, chunk) order.

    Only (article_id, passage count) goes through the ordering, written once so that the
    range sampling does not read the texts again; the texts move once,
    in the join that brings each article its first id. All chunks but an article's
    last are full, so a kept chunk's place in its article is its chunk number.
    """
    counts = settle(articles.select("article_id", kept_chunks(F.col("text"), size, min_words).alias("_n")))
    starts = running_start(counts, [F.col("article_id")], F.col("_n"), "_first").drop("_n")
    passages = titled(chunk(articles.join(starts, "article_id"), size, min_words))
    return passages.select(
        (F.col("_first") + F.col("chunk_no")).alias("passage_idx"),
        "article_id", "chunk_no", "n_words", "text",
    )


def corpus_counts(articles: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: articles, articles with a passage, passages."""
    both = articles.select("article_id", F.lit(0).alias("_p")).unionByName(
        passages.groupBy("article_id").agg(F.count(F.lit(1)).alias("_p"))
    )
    per = both.groupBy("article_id").agg(F.sum("_p").alias("_p"))
    return per.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_if(F.col("_p") > 0).alias("n_articles_kept"),
        F.sum("_p").alias("n_passages"),
    )


def encode_hashed(df: DataFrame, text: str, dim: int = 256, max_tokens: int = 256) -> DataFrame:
    """The built-in encoder: hashed word counts scaled to length one."""
    tokens = F.slice(words(F.lower(F.col(text))), 1, max_tokens)
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim).transform(
        df.withColumn("_tokens", tokens)
    )
    scaled = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return (
        scaled.withColumn("n_tokens", F.size("_tokens"))
        .withColumn("embedding", vector_to_array("_unit", "float32"))
        .drop("_tokens", "_tf", "_unit")
    )


def encode_with(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """A user's encoder, called once per Arrow batch; its rows are scaled to length one.

    The batch size is `spark.sql.execution.arrow.maxRecordsPerBatch`.
    """
    def encode(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(encoder(texts.tolist()), dtype=np.float32)
        lengths = np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(matrix / lengths))

    # Only the text goes to Python; the other columns stay as they are.
    udf = F.pandas_udf(encode, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR).asNondeterministic()
    return df.withColumn("embedding", udf(F.col(text)))


def pool_tokens(df: DataFrame, tokens: str, mask: str, floor: float | None = 1e-9) -> DataFrame:
    """Masked mean of a row's token vectors, scaled to length one."""
    mean = vectors.masked_mean(F.col(tokens), F.col(mask), floor)
    return df.withColumn("pooled", mean).withColumn("embedding", vectors.l2_normalise(F.col("pooled")))


def pool_token_rows(df: DataFrame, keys: list[str], dim: str, value: str, mask: str) -> DataFrame:
    """The same mean for tokens in long form: a row per (key, token, dimension)."""
    weight = F.greatest(F.sum(F.col(mask).cast("double")), F.lit(1e-9))
    return df.groupBy(*keys, dim).agg(
        (F.sum(F.col(value).cast("double") * F.col(mask)) / weight).alias("pooled")
    )
