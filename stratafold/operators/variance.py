"""Variance models and non-linear least squares: driver steps on Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_all, by_value
from .gram import outer_rows


def gaussian_nll(r: Column, terms: Sequence[Column], coefs: Sequence) -> Column:
    """Row negative log likelihood with variance sum_j coef_j term_j."""
    v = add_all([t * c for t, c in zip(terms, coefs)])
    return 0.5 * (F.log(2 * F.pi() * v) + r * r / v)


def fit_variance(df: DataFrame, resid: str, terms: Sequence[Column], fold: str = "fold", steps: int = 12) -> dict:
    """v = sum_j exp(theta_j) term_j by Fisher scoring, for all outer folds together: {fold: coefs}."""
    from .folds import fold_ids

    folds = fold_ids(df, fold)
    k = len(terms)
    names = [f"t{i}" for i in range(k)]
    rows = outer_rows(df.select(fold, F.col(resid).alias("r"), *[t.alias(n) for t, n in zip(terms, names)]), fold, folds)
    init = {r["outer"]: r for r in rows.groupBy("outer").agg(F.avg(F.col("r") * F.col("r")).alias("v"), *[F.avg(n).alias(n) for n in names]).collect()}
    th = {f: np.log(np.array([init[f]["v"] / k / max(init[f][n], 1e-9) for n in names])) for f in folds}
    for _ in range(steps):
        part = [F.col(n) * by_value("outer", {f: float(np.exp(th[f][i])) for f in folds}, 1.0) for i, n in enumerate(names)]
        v = add_all(part)
        r2 = F.col("r") * F.col("r")
        aggs = [F.sum(0.5 * (1 / v - r2 / (v * v)) * p).alias(f"g{i}") for i, p in enumerate(part)]
        aggs += [F.sum(0.5 * part[i] * part[j] / (v * v)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        moved = 0.0
        for row in rows.groupBy("outer").agg(*aggs).collect():
            g = np.array([row[f"g{i}"] for i in range(k)])
            h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            d = np.clip(np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(k), g), -2, 2)
            th[row["outer"]] = np.clip(th[row["outer"]] - d, -40, 40)
            moved = max(moved, float(np.abs(d).max()))
        if moved < 1e-6:
            break
    return {f: np.exp(t) for f, t in th.items()}


def nll_gain(df: DataFrame, resid: str, base: Sequence[Column], extra: Sequence[Column], fold: str = "fold") -> DataFrame:
    """Cross-validated likelihood gain of the larger variance model per fold."""
    out = []
    for terms in (base, [*base, *extra]):
        c = fit_variance(df, resid, terms, fold)
        coefs = [by_value(fold, {f: float(v[i]) for f, v in c.items()}) for i in range(len(terms))]
        out.append(gaussian_nll(F.col(resid), terms, coefs))
    return df.groupBy(fold).agg(F.sum(out[0]).alias("nll_base"), F.sum(out[1]).alias("nll_full"), F.sum(out[0] - out[1]).alias("gain"))


def crossfit_nonlinear(df: DataFrame, y: str, form: Callable[[Sequence[Column]], Column], start: Sequence[float], scale: float = 20.0, fold: str = "fold",
                       steps: int = 8, out: str = "pred") -> tuple[DataFrame, dict]:
    """Robust (soft-L1) Gauss-Newton for a named formula; derivatives are differences of the same Column expression.

    Each step is one aggregate of J'WJ and J'Wr for all outer folds; only these small matrices reach the driver.
    """
    from .folds import fold_ids

    folds = fold_ids(df, fold)
    k = len(start)
    rows = outer_rows(df, fold, folds)
    th = {f: np.array(start, float) for f in folds}
    damp = {f: 1e-3 for f in folds}
    best = {f: (np.inf, None) for f in folds}
    ps = [F.col(f"_p{i}") for i in range(k)]
    h = 1e-4

    def with_params(d, at):
        return d.withColumns({f"_p{i}": by_value(at, {f: float(t[i]) for f, t in th.items()}, 0.0) for i in range(k)})

    for _ in range(steps):
        d = with_params(rows, "outer")
        r = form(ps) - F.col(y)
        z = F.pow(r / scale, 2)
        w = 1 / F.sqrt(1 + z)
        jac = []
        for i in range(k):
            e = h * F.greatest(F.lit(1.0), F.abs(ps[i]))
            up, down = list(ps), list(ps)
            up[i], down[i] = ps[i] + e, ps[i] - e
            jac.append((form(up) - form(down)) / (2 * e))
        p = d.select("outer", r.alias("r"), w.alias("w"), (2 * (F.sqrt(1 + z) - 1)).alias("loss"), *[j.alias(f"j{i}") for i, j in enumerate(jac)])
        aggs = [F.sum("loss").alias("loss")] + [F.sum(F.col("w") * F.col(f"j{i}") * F.col("r")).alias(f"g{i}") for i in range(k)]
        aggs += [F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        for row in p.groupBy("outer").agg(*aggs).collect():
            f = row["outer"]
            if row["loss"] <= best[f][0]:
                g = np.array([row[f"g{i}"] for i in range(k)])
                a = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                best[f] = (row["loss"], (th[f].copy(), g, a))
                damp[f] = max(damp[f] / 4, 1e-9)
            else:
                damp[f] *= 16
            t0, g, a = best[f][1]
            th[f] = t0 - np.linalg.solve(a + damp[f] * np.diag(np.diag(a) + 1e-12), g)
    th = {f: b[1][0] for f, b in best.items()}
    return with_params(df, fold).withColumn(out, form(ps)).drop(*[f"_p{i}" for i in range(k)]), th
