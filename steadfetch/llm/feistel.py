"""A keyed permutation of 0 .. n-1: an unbalanced Feistel network with cycle walking.

x is written as (left, right) on a grid of a times b points, a*b >= n, with a and b near the
square root of n. Each round adds a hash of one half to the other, modulo its size, and swaps
them. A point that lands outside 0 .. n-1 is walked on until it is back inside; fewer than
2*sqrt(n) points of the grid are outside, so walks are short. All of it is column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash

ROUNDS = 4


def grid(n: Column) -> tuple[Column, Column]:
    """The sides a and b of the grid for 0 .. n-1."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("bigint")
    return a, F.greatest(F.ceil(n.cast("double") / a), F.lit(1)).cast("bigint")


def _step(point: Column, n: Column, seed: Column) -> Column:
    """The image of `point` on the grid."""
    a, b = grid(n)
    halves = F.struct(F.floor(point / b).alias("l"), (point % b).alias("r"))

    def one_round(s: Column, k: Column) -> Column:
        side = F.when(k % 2 == 0, a).otherwise(b)
        return F.struct(s["r"].alias("l"), ((s["l"] + stable_hash(seed, k, s["r"])) % side).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, one_round, lambda s: s["l"] * b + s["r"])


def longest_walk(sizes: DataFrame) -> int:
    """The most further steps any point needs; `sizes` has n and seed, one row per permutation.

    Only the points outside 0 .. n-1 are looked at: their images that are outside as well get fewer
    with each step, until walks that come from inside have all ended.
    """
    a, b = grid(F.col("n"))
    outside = (
        sizes.select("n", "seed", (a * b).alias("points")).where("points > n")
        .select("n", "seed", F.explode(F.sequence(F.col("n"), F.col("points") - 1)).alias("x"))
    )
    walks, left = 0, outside.count()
    while left:
        outside = outside.withColumn("x", _step(F.col("x"), F.col("n"), F.col("seed"))).where("x >= n")
        before, left = left, outside.count()
        if left == before:
            # What never leaves is a cycle outside 0 .. n-1, which no walk from inside can enter.
            break
        walks += 1
    return walks


def permuted(point: Column, n: Column, seed: Column, walks: int) -> Column:
    """The image of `point` under the permutation of 0 .. n-1 keyed by `seed`.

    n and seed may differ from row to row; `walks` comes from `longest_walk` over all of them and
    makes the result exact for every row.
    """
    walk = lambda x, w: F.when((w > 0) & (x < n), x).otherwise(_step(x, n, seed))
    return F.aggregate(F.sequence(F.lit(0), F.lit(walks)), point, walk)
