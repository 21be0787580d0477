"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import dense_ordinal
from .feistel import longest_walk, permuted
from .frames import hashable, pack, unpack


def shard(docs: DataFrame, shards: int, seed: int = 0, by: str = "doc_id") -> DataFrame:
    """All columns of `docs` with `shard` (0 .. shards-1) and `slot` (0, 1, ... inside the shard).

    Rows are numbered in the order of (`by`, the row's own hash); nulls come first. Row i goes
    to place p(i) of a keyed permutation p of all row numbers; its shard is p(i) mod shards and
    its slot p(i) div shards. So shards differ by one row at most, slots have no gaps, and the
    place of row i, or the row at a place, is computed without a look at other rows.

    Null keys and repeated rows are numbered like all others; equal rows may swap places, which
    no reader can tell. Columns of `docs` called shard or slot are replaced. An empty table
    gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    packed = pack(docs, _by=by)
    packed = packed.withColumn("_hash", hashable(packed)).withColumn("_any", F.monotonically_increasing_id())
    # The last key spreads rows that are equal in all columns over several ranges.
    rows = dense_ordinal(packed, [F.col("_by"), F.col("_hash"), F.col("_any")], "_row")
    total = rows.count()
    n, key = F.lit(total).cast("bigint"), F.lit(seed).cast("bigint")
    walks = longest_walk(docs.sparkSession.range(1).select(n.alias("n"), key.alias("seed"))) if total else 0
    placed = rows.withColumn("_place", permuted(F.col("_row"), n, key, walks))
    return unpack(
        placed, docs.columns,
        shard=(F.col("_place") % shards).cast("int"), slot=F.expr(f"_place div {shards}"),
    )
