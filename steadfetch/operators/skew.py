"""Joins whose key may hold a large share of the rows.

Which keys those are is a small table (key, salts), found by an exact count and broadcast: there are at most
MOST_HOT of them, whatever the number of rows, and none passes through the driver's program.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

# A key is split above this share of the rows, and in any case above what one task should hold.
HOT_SHARE = 0.005
TASK_ROWS = 1_000_000
# No more keys than this are hot: a hot key holds more than one in MOST_HOT rows.
MOST_HOT = 500_000
# Tables of at most this many rows are broadcast after their rows were counted.
SMALL_ROWS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """The keys to split, as a table (key, salts) of at most MOST_HOT rows; None if there are none."""
    table: DataFrame | None

    def mark(self, df: DataFrame, key: str, name: str = "_salts") -> DataFrame:
        """Adds `name`: how many parts the row's key is split in, null for other keys. The rows stay where they are."""
        if self.table is None:
            return df.withColumn(name, F.lit(None).cast("int"))
        known = self.table.select(F.col("key").alias("_hot_key"), F.col("salts").alias(name))
        return df.join(F.broadcast(known), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, task_rows: int = TASK_ROWS) -> HotKeys:
    """The values of `key` that hold at least `share` of the rows, or `task_rows` rows; null is none of them.

    Counts combine per task before they move. A key gets one salt for each time it reaches the bound.
    """
    rows = df.count()
    floor = max(min(share * rows, task_rows), rows / MOST_HOT, 1)
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    often = counts.where((F.col("n") >= floor) & F.col("key").isNotNull())
    salts = F.greatest(F.ceil(F.col("n") / F.lit(floor)), F.lit(2)).cast("int")
    table = settle(often.select("key", salts.alias("salts")))
    return HotKeys(None if table.isEmpty() else table)


def split_hot_join(
    big: DataFrame, small: DataFrame, keys: list[str], key: str, how: str = "inner",
    share: float = HOT_SHARE, hot: HotKeys | None = None,
) -> DataFrame:
    """Equi-join in which the rows of a hot `key` spread over many tasks.

    Rows of `big` with a hot key get one of its salts, as many as its rows call for; the few matching rows of
    `small` are repeated once per salt. All other keys have salt 0 on both sides, null keys of `big`, which
    match nothing, any. The salt is a hash of the row, so a task that runs again gives the same one. Right for
    inner, left, left_semi and left_anti joins with `big` on the left.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no split join for {how}")
    found = hot_keys(big, key, share) if hot is None else hot
    if found.table is None:
        return big.join(small, keys, how)
    hashed = [F.col(f"`{f.name}`") for f in big.schema.fields if not _has_map(f.dataType)]
    parts = F.coalesce("_salts", F.when(F.col(key).isNull(), F.lit(1024)), F.lit(1))
    left = found.mark(big, key).withColumn("_salt", F.pmod(F.xxhash64(*hashed), parts).cast("int")).drop("_salts")
    repeats = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = found.mark(small, key).withColumn("_salt", F.explode(repeats)).drop("_salts")
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def _has_map(dtype) -> bool:
    return "map<" in dtype.simpleString()


def join_group_stats(big: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Brings per-group figures back to the rows.

    Few groups (counted first) are broadcast, so the rows do not move even when one
    group holds most of them. Many groups meet in a join that splits the hot ones.
    """
    stats = settle(stats)
    if stats.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(stats), keys)
    mark = F.xxhash64(*keys)
    joined = split_hot_join(big.withColumn("_group", mark), stats.withColumn("_group", mark),
                            keys + ["_group"], "_group")
    return joined.drop("_group")
