"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .frames import pack, tidied
from .tokens import encoder, slices

# Lengths are summed in bands of this width, and the bands among themselves.
BAND = 4096


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The histogram: one row per encoded length with the number of documents, `length` and `docs`.

    A null or empty text has length 0. Lengths are counted per slice of texts before they are shuffled, so
    a length that many documents share is one row per slice.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for begin, end in slices(batch.column(0)):
                _, bounds = encoder(path).batch(batch.column(0).slice(begin, end - begin))
                length, docs = np.unique(np.diff(bounds), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs)], names=["length", "docs"])

    counted = pack(docs, text=text).select("text").mapInArrow(count, "length bigint, docs bigint")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """What every context limit would mean, one row per length that occurs.

    For limit = `length`: `docs` and `tokens` of exactly this length; `docs_longer` and `tokens_longer`
    above it; `docs_within` up to it; `tokens_truncated`, the corpus with every document cut to the
    limit; `share_within`, the share of documents up to it, which makes the length a quantile.

    Sums run inside bands of lengths, from the longest down, and then over the bands, so that no task
    holds more than a band or the list of bands. An empty histogram gives no rows.
    """
    rows = settle(
        histogram.withColumns({"tokens": F.col("docs") * F.col("length"), "band": F.floor(F.col("length") / BAND)})
    )
    longer = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("band").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    bands = bands.select(
        "band", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    summed = rows.withColumns({
        "docs_longer": F.coalesce(F.sum("docs").over(longer), F.lit(0)),
        "tokens_longer": F.coalesce(F.sum("tokens").over(longer), F.lit(0)),
    }).join(bands, "band")
    docs_longer = F.col("docs_longer") + F.col("docs_above")
    tokens_longer = F.col("tokens_longer") + F.col("tokens_above")
    return summed.select(
        "length", "docs", "tokens", docs_longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"),
        (F.col("all_docs") - docs_longer).alias("docs_within"),
        (F.col("all_tokens") - tokens_longer + docs_longer * F.col("length")).alias("tokens_truncated"),
        ((F.col("all_docs") - docs_longer) / F.col("all_docs")).alias("share_within"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length with at least `share` of the documents up to it; one row."""
    return sums.where(F.col("share_within") >= share).agg(F.min("length").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut to `limit`, also between lengths that occur; one row."""
    # The shortest length above the limit knows how many documents are cut and what they hold.
    cut = F.struct(
        (F.col("docs_longer") + F.col("docs")).alias("n"), (F.col("tokens_longer") + F.col("tokens")).alias("t")
    )
    above = F.min_by(cut, F.when(F.col("length") > limit, F.col("length"))).alias("above")
    found = sums.agg(above, F.max("tokens_truncated").alias("whole"), F.max("length").alias("longest"))
    cut_total = F.col("whole") - F.col("above.t") + F.col("above.n") * limit
    return found.select(F.when(F.col("longest") <= limit, F.col("whole")).otherwise(cut_total).alias("tokens"))
