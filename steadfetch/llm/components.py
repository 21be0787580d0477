"""Connected components of a links table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours over to its smallest one."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours over to the smallest of them, and joins it itself."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """The nodes of `links` with `comp`, the smallest node they are connected to.

    Links stay a table throughout: each round joins every node with one neighbour, is written to
    the shared folder, and halves the distances at least; rounds end when nothing moves. Self-links
    and repeated links are fine; a null end is left out. No links, no rows.
    """
    pairs = links.select(F.col(one).alias("x"), F.col(other).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    stars = settle(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark = _mark(stars)
    while True:
        stars = settle(_small_star(_large_star(stars).distinct()).distinct())
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    heads = stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(heads)
