"""Spline bases, random features and unit-level designs pooled to entities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import column_quantiles
from ..functions.scalar import add_all, linear
from .metrics import wmean


def _basis_values(t: np.ndarray, degree: int, x: np.ndarray, i: int) -> np.ndarray:
    """Cox-de Boor recursion for one basis function at a few points (driver only)."""
    if degree == 0:
        return ((x >= t[i]) & (x < t[i + 1])).astype(float)
    out = np.zeros_like(x)
    if t[i + degree] > t[i]:
        out += (x - t[i]) / (t[i + degree] - t[i]) * _basis_values(t, degree - 1, x, i)
    if t[i + degree + 1] > t[i + 1]:
        out += (t[i + degree + 1] - x) / (t[i + degree + 1] - t[i + 1]) * _basis_values(t, degree - 1, x, i + 1)
    return out


def spline_knots(df: DataFrame, cols: Sequence[str], n_knots: int = 5) -> dict[str, list[float]]:
    """Quantile knots of the training rows, first and last at the extremes."""
    q = column_quantiles(df, cols, [i / (n_knots - 1) for i in range(n_knots)])
    return {c: sorted(set(v)) for c, v in q.items()}


def spline_basis(c: str | Column, knots: Sequence[float], degree: int = 3, last: bool = False) -> list[Column]:
    """B-spline basis as one polynomial per knot interval; linear continuation outside the knots.

    Each interval's polynomial is found once on the driver, so a basis value is a CASE of cubics
    that stays inside generated code. ``last`` keeps the redundant last function.
    """
    x = F.col(c) if isinstance(c, str) else c
    k = np.asarray(knots, float)
    lo, hi = k[1] - k[0], k[-1] - k[-2]
    t = np.r_[[k[0] - lo * i for i in range(degree, 0, -1)], k, [k[-1] + hi * i for i in range(1, degree + 1)]]
    n = len(k) + degree - 1
    out = []
    for i in range(n if last else n - 1):
        polys = []
        for a, b in zip(k, k[1:]):
            u = np.linspace(0, 1, degree + 1) * (b - a) * 0.999999
            polys.append(np.linalg.solve(np.vander(u, degree + 1, increasing=True), _basis_values(t, degree, a + u, i)))

        def at(p, origin):
            d = x - float(origin)
            val = F.lit(float(p[-1]))
            for coef in reversed(p[:-1]):
                val = val * d + float(coef)
            return val

        end = polys[-1]
        w = k[-1] - k[-2]
        v1, s1 = sum(c_ * w ** e for e, c_ in enumerate(end)), sum(e * c_ * w ** (e - 1) for e, c_ in enumerate(end) if e)
        expr = at([v1, s1], k[-1])
        for a, p in reversed(list(zip(k[:-1], polys))):
            b = k[list(k).index(a) + 1]
            expr = F.when(x < float(b), at(p, a)).otherwise(expr)
        expr = F.when(x < float(k[0]), at(polys[0][:2], k[0])).otherwise(expr)
        out.append(F.when(x.isNotNull(), expr))
    return out


def tensor_products(a: Sequence[Column], b: Column | Sequence[Column]) -> list[Column]:
    bs = b if isinstance(b, (list, tuple)) else [b]
    return [x * y for x in a for y in bs]


def pooled_basis(units: DataFrame, key: str, cols: dict[str, list[float]], weight: Column, jensen: bool = False) -> DataFrame:
    """Entity design from unit measures: the weighted mean of the basis, or (``jensen``) the basis of the weighted mean."""
    if jensen:
        m = units.groupBy(key).agg(*[wmean(c, weight).alias(c) for c in cols])
        return m.select(key, *[b.alias(f"{c}_s{i}") for c, k in cols.items() for i, b in enumerate(spline_basis(c, k))])
    return units.groupBy(key).agg(*[wmean(b, weight).alias(f"{c}_s{i}") for c, k in cols.items() for i, b in enumerate(spline_basis(c, k))])


def random_features(units: DataFrame, key: str, cols: Sequence[str], weight: Column, n: int, scale: float, seed: int = 0) -> DataFrame:
    """Number- and weight-pooled cosine features; the projection is a small literal matrix."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / scale, (n, len(cols))), rng.uniform(0, 2 * np.pi, n)
    feats = [F.cos(linear(w[i], cols, float(b[i]))) * float(np.sqrt(2 / n)) for i in range(n)]
    return units.groupBy(key).agg(*[F.avg(f).alias(f"rn{i}") for i, f in enumerate(feats)], *[wmean(f, weight).alias(f"rw{i}") for i, f in enumerate(feats)])


def sum_of_basis(c: str, knots: Sequence[float]) -> Column:
    return add_all(spline_basis(c, knots, last=True))
