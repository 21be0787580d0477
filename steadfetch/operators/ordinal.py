"""Dense numbers and running sums over a total order, without a global window.

The rows are range partitioned and sorted, written once so that both passes see
the same partitions, and numbered from per-partition totals. No task holds more
than one range, whatever the order keys look like, as long as the keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .skew import HotKeys, hot_keys

_ROW_BITS = 33


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    return settle(placed).withColumn("_part", F.shiftright("_at", _ROW_BITS))


def _part_starts(placed: DataFrame, total: Column) -> DataFrame:
    """Running total before each range; one row per partition, so one task is enough."""
    per_part = placed.groupBy("_part").agg(total.alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))


def dense_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in the given order. The order keys must be unique."""
    placed = _ranged(df, order)
    starts = _part_starts(placed, F.count(F.lit(1)))
    in_part = F.col("_at") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + in_part)
        .drop("_part", "_at", "_start")
    )


def running_start(df: DataFrame, order: list[Column], weight: Column, name: str = "start") -> DataFrame:
    """Adds `name`: the sum of `weight` over all rows before this one."""
    placed = _ranged(df.withColumn("_w", weight), order)
    starts = _part_starts(placed, F.sum("_w"))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_in"))
        .drop("_part", "_at", "_start", "_in", "_w")
    )


def ordinal_in_group(
    df: DataFrame, group: list[str], order: list[Column], name: str = "position", hot: HotKeys | None = None
) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... inside each group, also for groups too large for one task.

    Ordinary groups are numbered in a window. `hot` says which values of the first group
    column may have a large share of the rows (found here when not given); those
    rows are numbered over ranges.
    """
    found = hot_keys(df, group[0]) if hot is None else hot
    place = Window.partitionBy(*group).orderBy(*order)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, (F.row_number().over(place) - 1).cast("bigint"))

    if found.table is None:
        return windowed(df)
    marked = found.mark(df, group[0])
    cold, large = (marked.where(f"_salts IS {what}").drop("_salts") for what in ("NULL", "NOT NULL"))
    return windowed(cold).unionByName(_over_ranges(large, group, order, name))


def _over_ranges(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The number is the global ordinal less the group's first. Only a group that opens a
    range can have begun before it, so the firsts are known per range: one small row
    per (range, group) joined back inside the range, and one row per range for the carry.
    """
    placed = _ranged(df, [F.col(c) for c in group] + order)
    same = Window.partitionBy("_part", *group)
    local = F.col("_at") - F.min("_at").over(same)
    runs = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return _with_carry(placed.withColumn("_local", local), runs, group, name)


def _with_carry(placed: DataFrame, runs: DataFrame, group: list[str], name: str) -> DataFrame:
    """Adds to each range's first group the rows it has in earlier ranges."""
    opening = F.struct(*group)
    edges = runs.groupBy("_part").agg(
        F.min_by(opening, "_first").alias("_open"),
        F.max_by(opening, "_first").alias("_close"),
        F.max_by("_n", "_first").alias("_close_n"),
        F.count(F.lit(1)).alias("_groups"),
    )
    # Ranges in order: a range made of one group passes its count on to the next.
    by_part = Window.partitionBy(F.lit(0)).orderBy("_part")
    to_here = by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lagged = edges.withColumn("_prev_close", F.lag("_close").over(by_part))
    begins = F.when((F.col("_groups") > 1) | F.coalesce(F.col("_prev_close") != F.col("_open"), F.lit(True)), 1)
    blocks = lagged.withColumn("_block", F.coalesce(F.sum(begins).over(to_here), F.lit(0)))
    in_block = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = blocks.withColumn("_tail", F.sum("_close_n").over(in_block))
    carry = tails.select(
        "_part",
        "_open",
        F.when(
            F.col("_prev_close") == F.col("_open"), F.lag("_tail").over(by_part)
        ).otherwise(F.lit(0)).alias("_carry"),
    )
    joined = placed.join(F.broadcast(carry), "_part")
    extra = F.when(F.struct(*group) == F.col("_open"), F.col("_carry")).otherwise(F.lit(0))
    return joined.withColumn(name, F.col("_local") + extra).drop(
        "_part", "_at", "_local", "_open", "_carry"
    )
