"""Column expressions shared by all operators (math, nulls, bins, hashing)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c, lo, hi) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ramp(c, lo, hi) -> Column:
    """Linear 0..1 ramp between two levels."""
    return clip((col(c) - lo) / (F.lit(hi) - lo), 0.0, 1.0)


def signed_log(c) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def signed_sqrt(c) -> Column:
    return F.signum(col(c)) * F.sqrt(F.abs(col(c)))


def digitize(c, edges: Sequence[float]) -> Column:
    """Left-closed bins: the number of edges <= value."""
    c = col(c)
    parts = [F.when(c >= float(e), 1).otherwise(0) for e in edges]
    return F.when(c.isNotNull(), reduce(lambda a, b: a + b, parts, F.lit(0))).cast("int")


def cut(c, edges: Sequence[float]) -> Column:
    """Right-closed bins: the number of inner edges < value; equal edges count once."""
    c = col(c)
    parts = [F.when(c > float(e), 1).otherwise(0) for e in sorted({e for e in edges if e is not None})]
    return F.when(c.isNotNull(), reduce(lambda a, b: a + b, parts, F.lit(0))).cast("int")


# Fixed values of the rational normal-CDF approximation 26.2.17 of Abramowitz and Stegun.
_NORM_P = 0.2316419
_NORM_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_pdf(c) -> Column:
    c = col(c)
    return F.exp(-c * c / 2) / F.sqrt(F.lit(2.0) * F.pi())


def norm_cdf(c) -> Column:
    """Normal CDF with absolute error below 1e-7 (Spark SQL has no ``erf``)."""
    c = col(c)
    t = 1 / (1 + _NORM_P * F.abs(c))
    poly = reduce(lambda acc, b: (acc + b) * t, reversed(_NORM_B), F.lit(0.0))
    upper = norm_pdf(c) * poly
    return F.when(c >= 0, 1 - upper).otherwise(upper)


# Expected maximum of n standard normals (the bias of picking the best of n variants).
EXPECTED_MAX = {1: 0.0, 2: 0.564, 3: 0.846, 4: 1.029, 5: 1.163, 10: 1.539, 20: 1.867, 30: 2.043, 50: 2.249,
                100: 2.508, 128: 2.58}


def expected_max_bias(n) -> Column:
    """Bias of the nearest tabulated count at or below ``n``; 0 below the table."""
    n = col(n)
    out = F.lit(0.0)
    for k in sorted(EXPECTED_MAX):
        out = F.when(n >= k, F.lit(EXPECTED_MAX[k])).otherwise(out)
    return out


def hash_uniform(*parts) -> Column:
    """Uniform (0, 1) number that depends only on the key parts, not on partitioning."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)


def md5_order(*parts) -> Column:
    """Pseudo-random sort key of the parts' text; any SQL engine with md5 gives the same order."""
    return F.md5(F.concat_ws(":", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("null")) for p in parts]))


def md5_uniform(*parts) -> Column:
    """Uniform [0, 1) number from the first 48 bits of ``md5_order``: slower than ``hash_uniform``, but portable."""
    return F.conv(F.substring(md5_order(*parts), 1, 12), 16, 10).cast("double") / float(1 << 48)


def md5_below(share: float, *parts) -> Column:
    """``md5_uniform(*parts) < share``, decided on the digits: hexadecimal text of one length sorts like its numbers."""
    edge = math.ceil(share * (1 << 48))
    return F.lit(edge > 0) if not 0 < edge < 1 << 48 else md5_order(*parts) < F.lit(f"{edge:012x}")


def by_value(key, table: dict, default=None) -> Column:
    """Small literal lookup (folds, cells, options) as a CASE expression: no join needed."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col(key) == F.lit(k), v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def linear(weights: Sequence[float], cols: Sequence, intercept: float = 0.0) -> Column:
    terms = [F.lit(float(w)) * col(c) for w, c in zip(weights, cols)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
