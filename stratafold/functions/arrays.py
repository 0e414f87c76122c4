"""Array column helpers for vectors stored one per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def total(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def mean(a) -> Column:
    return total(a) / F.size(col(a))


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(col(a), lambda v: v * v)))


def std(a) -> Column:
    """Population standard deviation of the elements."""
    m = mean(a)
    return F.sqrt(F.greatest(F.lit(0.0), total(F.transform(col(a), lambda v: v * v)) / F.size(col(a)) - m * m))


def permute(a, order: Sequence[int]) -> Column:
    """Element i of the result is element ``order[i]`` of the input."""
    return F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.element_at(col(a), i + 1))
