"""Mixing sources to target weights: exact quotas, a hypergeometric splitting tree, permuted blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..operators.ordinal import running_start
from ..session import settle
from .feistel import longest_walk, permuted
from .frames import hashable, pack, unpack


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """Adds `target` to (source_size, weight): shares by weight of all sizes, none above `most` x its size.

    Sorted by how soon their limit is reached, the limited sources are the first ones: the rest
    share what those leave. One row per source, so one ordered pass over them is small.
    """
    limit = most * F.col("source_size")
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("_limit") / F.col("weight"), "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = (
        sizes.withColumns({"weight": F.col("weight").cast("double"), "_limit": limit.cast("double")})
        .withColumns({"_all": F.sum("source_size").over(every).cast("double"), "_weights": F.sum("weight").over(every)})
        .withColumns({"_level": level, "_limit_at": F.row_number().over(by_limit)})
    )
    # The level of the first source whose limit lies above it holds for all that follow.
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct("_limit_at", "_level"))).over(every)
    return (
        rows.withColumn("_found", first["_level"])
        .withColumn("target", F.least(F.col("_limit"), F.coalesce(F.col("_found") * F.col("weight"), F.col("_limit"))))
        .drop("_limit", "_all", "_weights", "_level", "_limit_at", "_found")
    )


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source go to each shard; rows are shards.

    The tree halves the shards at each node and draws the left half's blocks per source from the
    multivariate hypergeometric distribution: as if all blocks were shuffled and dealt out, but
    with exact totals per source and shard and no pass over blocks. Shards differ by one block.
    """
    total = sum(quotas)
    if total >= 10**9:
        raise ValueError("a mix has fewer than a billion blocks; use larger blocks")
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    size = [total // shards + (k < total % shards) for k in range(shards)]

    def divide(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(left, sum(size[low:middle]), method="marginals")
        divide(low, middle, draw)
        divide(middle, high, left - draw)

    divide(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def mix(
    docs: DataFrame, weights: DataFrame, size: str = "size", source: str = "source", shards: int = 16,
    most: float = 3.0, block: int = 16384, seed: int = 0,
) -> DataFrame:
    """All columns of `docs`, one row per document, with what the mix takes of it.

    `weights` has one row per source: source (may be null) and a positive weight. Sources share the
    total of `size` by weight; a target stops at `most` times its source's size and the others
    take the rest. A source's documents lie on a line in an order fixed by a hash of each row, one
    copy of the line after the other; the mix takes what lies before the target, so that one document
    per source may be taken in part and all others whole.
    The line is cut into blocks of `block`; the splitting tree gives every output shard exact
    numbers of blocks per source, a permutation of the block numbers says which. Added: `source_size`,
    `target` (both of its source) and `draws`, an array of (copy, shard, local_order, words), empty
    for a document that is not taken; `words` is its size, or less where the target cuts it. `materialise` makes rows of them.

    Null sizes count as 0; documents of size 0 are never drawn. A source without weight gets target
    0. Repeated rows are separate documents. Reruns agree. Clashing columns are replaced.
    """
    spark = docs.sparkSession
    packed = pack(docs, _size=size, _source=source)
    packed = packed.withColumn("_size", F.coalesce(F.col("_size").cast("bigint"), F.lit(0)))
    totals = packed.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    known = weights.select(F.col("source").alias("_w"), F.col("weight").cast("double").alias("weight"))
    table = totals.join(known, totals["source"].eqNullSafe(known["_w"]), "left").drop("_w")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    table = table.withColumn("_rank", F.row_number().over(order).cast("bigint"))
    weighed = targets(table.where("weight > 0 AND source_size > 0"), most).select("_rank", "target")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    table = settle(
        table.join(weighed, "_rank", "left")
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("n", F.ceil(F.col("target") / block).cast("bigint"))
    )
    plan = _dealt(table, shards, seed)
    walks = longest_walk(plan.where("n > 0").select("n", F.col("_seed").alias("seed")))
    rows = packed.join(table.withColumnRenamed("source", "_s").drop("weight"), F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.drop("_s", "n").withColumn("_place", stable_hash(seed, hashable(packed)))
    # Equal rows have equal places; the last key spreads them over ranges.
    rows = rows.withColumn("_any", F.monotonically_increasing_id())
    rows = running_start(rows, [F.col("_rank"), F.col("_place"), F.col("_any")], F.col("_size"), "_begin")
    rows = rows.join(plan, "_rank", "left")
    start = lambda c: F.col("_begin") - F.col("_before") + c * F.col("source_size")
    copies = F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1))
    taken = F.filter(copies, lambda c: (F.col("_size") > 0) & (start(c) + 1 <= F.col("target")))

    def draw(c: Column) -> Column:
        number = F.least(F.floor(start(c) / block), F.col("n") - 1)
        at = permuted(number, F.col("n"), F.col("_seed"), walks)
        shard = F.size(F.filter("_ends", lambda end: end <= at)).cast("int")
        local = stable_hash(F.col("_seed"), c, F.col("_begin"))
        words = F.least(F.col("_size"), F.floor(F.col("target") - start(c)))
        return F.struct(c.alias("copy"), shard.alias("shard"), local.alias("local_order"), words.alias("words"))

    return unpack(
        rows, docs.columns, source_size=F.col("source_size"), target=F.col("target"), draws=F.transform(taken, draw)
    )


def _dealt(table: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per source the running block quotas of the shards; one number per source and shard."""
    spark = table.sparkSession
    known = table.select("_rank", "n").orderBy("_rank").collect()
    quotas = split_quotas([r["n"] for r in known], shards, seed)
    ends = np.cumsum(quotas, axis=0)
    rows = [(r["_rank"], r["n"], seed * 1_000_003 + r["_rank"], [int(x) for x in ends[:, k]]) for k, r in enumerate(known)]
    return settle(spark.createDataFrame(rows, "_rank bigint, n bigint, _seed bigint, _ends array<bigint>"))


def materialise(mixed: DataFrame) -> DataFrame:
    """One row per drawn copy, with copy, shard, local_order and words instead of `draws`.

    Shards are dealt over tasks by shard and a range of the local order, so a shard of any size is
    shuffled in parts: rows of a task are in the order in which the shard is to be read.
    """
    rows = mixed.withColumn("_d", F.explode("draws")).drop("draws", "copy", "shard", "local_order", "words")
    rows = rows.select("*", "_d.copy", "_d.shard", "_d.local_order", "_d.words").drop("_d")
    return rows.repartitionByRange("shard", "local_order").sortWithinPartitions("shard", "local_order")
