"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def norm(vec: Column) -> Column:
    total = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def l2_normalise(vec: Column, floor: float = 1e-12) -> Column:
    """`vec` scaled to length one; a zero vector stays zero."""
    return bind(
        F.greatest(norm(vec), F.lit(floor)),
        lambda scale: F.transform(vec, lambda x: x.cast("double") / scale),
    )


def masked_mean(tokens: Column, mask: Column, floor: float | None = 1e-9) -> Column:
    """Mean of the token vectors whose mask is 1 (array<array<float>>, array<int>).

    `floor` keeps the denominator above zero; with None a row without any
    unmasked token gives null instead.
    """
    weight = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    if floor is None:
        weight = F.when(weight > 0, weight)
    else:
        weight = F.greatest(weight, F.lit(floor))
    dim = F.size(F.get(tokens, 0))
    zero = F.array_repeat(F.lit(0.0), dim)
    sums = F.aggregate(
        F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m)),
        zero,
        lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b),
    )
    return bind(weight, lambda w: F.transform(sums, lambda s: s / w))
