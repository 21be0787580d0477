"""A stored index of passage vectors by cell: fitted once on a bounded sample, appended to, and read by cell.

Layout below a path: `centres` (cell, centre), one row per cell, and `vectors` (passage_idx, embedding)
partitioned by cell. A search reads the partitions of the cells that its queries probe and no others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, settle_last
from .retrieval import (
    BROADCAST_BYTES, PASSAGE_BLOCK, QUERY_BLOCK, best_hits, fit_cells, nearest_cells, search_cells, with_cells, with_found, with_least,
)

# The centres are fitted on about this many vectors at most, picked by a hash of their ids.
SAMPLE_ROWS = 100_000


def sample(passages: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """About `rows` passages by a hash of their ids, or all if there are no more."""
    total = passages.count()
    if total <= rows:
        return passages
    # A hash is evenly spread over its range; the share below the bound is rows / total.
    place = F.pmod(F.xxhash64(F.lit(seed), "passage_idx"), F.lit(1_000_000_007))
    return passages.where(place < int(1_000_000_007 * rows / total))


def build(passages: DataFrame, path: str, n_cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> None:
    """Fits `n_cells` centres and writes the passages (passage_idx, embedding) by their nearest one.

    Search time is least with about as many cells as the root of the number of passages. All centres
    go to every task, so their size is checked.
    """
    centres = fit_cells(settle(sample(passages, sample_rows, seed)), n_cells, seed)
    if centres.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{n_cells} centres take {centres.nbytes} bytes; every task gets them, {BROADCAST_BYTES} is the most")
    rows = [(cell, [float(x) for x in centre]) for cell, centre in enumerate(centres)]
    passages.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    append(passages, path)


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def append(passages: DataFrame, path: str) -> None:
    """Adds passages to the index at `path` without fitting it again; an id that is there already is there twice."""
    placed = nearest_cells(passages, ["passage_idx"], centres_of(passages.sparkSession, path), 1)
    # A range of (cell, hash) has few cells and so few files; a cell of any size is split over ranges.
    dealt = settle(placed.withColumnRenamed("_cell", "cell")).repartitionByRange("cell", F.xxhash64("passage_idx"))
    dealt.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def search(
    queries: DataFrame, path: str, k: int = 100, probes: int = 16, keys: list[str] | None = None,
    query_block: int = QUERY_BLOCK, passage_block: int = PASSAGE_BLOCK, found: DataFrame | None = None, probed: int = 0,
) -> DataFrame:
    """Top-k among the passages of each query's `probes` nearest cells: (keys, rank from 0, passage_idx, score).

    With as many probes as cells the result is exact. `found`, the result of the same search with `probed` cells, is
    carried on: its cells are not visited again, so more passages must not have come to the index since.
    """
    spark, keys = queries.sparkSession, keys or ["query_idx", "pert_idx"]
    centres = centres_of(spark, path)

    def further() -> DataFrame:
        asked = settle(with_cells(with_least(queries, found, keys, k), keys, centres, probes, probed if found is not None else 0))
        # At most one number per cell; the filter reaches the scan as partitions to read.
        wanted = [r[0] for r in asked.select(F.explode("_cells")).distinct().collect()]
        vectors = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(wanted)).withColumnRenamed("cell", "_cell")
        return best_hits(with_found(search_cells(asked, vectors, k, keys, query_block, passage_block), found), keys, k)

    return settle_last(spark, further)
