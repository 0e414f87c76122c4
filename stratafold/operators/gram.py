"""Distributed sufficient statistics and closed-form cross-fitting.

``gram`` makes one pass over the rows and returns one small matrix per group. Because the
statistics add up, "fit on the other folds" is the total minus one fold: one scan serves all
folds, all penalties and all column subsets. Only these column-sized matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import by_value, col, linear

NARROW = 13  # up to this many columns the products are plain aggregate expressions inside generated code


def gram(df: DataFrame, cols: Sequence, by: Sequence[str] = (), weight=None) -> dict:
    """{group key: matrix of weighted cross products} for the given columns or expressions.

    ``by`` holds labels with few values (fold, cell, option, replicate). Rows with a NULL in any
    used column are left out. Few columns: one aggregate expression per product. Many columns: dense
    products per Arrow batch. Either way one pass over the rows for all groups.
    """
    exprs = [col(c) for c in cols]
    k = len(exprs)
    w = F.lit(1.0) if weight is None else col(weight)
    names = [f"_c{i}" for i in range(k)]
    if k > NARROW:
        return _wide_gram(df.select(*by, w.cast("double").alias("_w"), F.array(*[e.cast("double") for e in exprs]).alias("_x")), k, list(by))
    names = [f"_c{i}" for i in range(k)]
    base = df.select(*by, w.cast("double").alias("_w"), *[e.cast("double").alias(n) for e, n in zip(exprs, names)]).dropna(subset=[*names, "_w"])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("_w") * F.col(f"_c{i}") * F.col(f"_c{j}")).alias(f"p{n}") for n, (i, j) in enumerate(pairs)]
    out: dict = {}
    for r in base.groupBy(*by).agg(*sums).collect():
        m = out[tuple(r[b] for b in by)] = np.zeros((k, k))
        for n, (i, j) in enumerate(pairs):
            m[i, j] = m[j, i] = r[f"p{n}"] if r[f"p{n}"] is not None else 0.0
    return out


def _wide_gram(base: DataFrame, k: int, by: list[str]) -> dict:
    """Cross products of many columns, given as one array column ``_x``: each task multiplies its Arrow batches as dense blocks,
    one matrix per group, and the matrices are added up element by element. One pass for any number of columns and groups.

    Rows with a NULL are dropped inside the task: a filter over dozens of named expressions would make the planner infer
    constraints between all of them.
    """

    def run(batches):
        parts: dict = {}
        for b in batches:
            values = b.column("_x").flatten()
            gap = np.asarray(values.is_null()).reshape(-1, k).any(axis=1) | np.asarray(b.column("_w").is_null())
            x = values.to_numpy(zero_copy_only=False).reshape(-1, k)
            w = b.column("_w").to_numpy(zero_copy_only=False)[:, None]
            keys = list(zip(*[b.column(c).to_pylist() for c in by])) if by else [()] * len(x)
            number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            code = np.fromiter((number[key] for key in keys), np.int64, len(keys))
            for key, i in number.items():
                own = (code == i) & ~gap
                if own.any():
                    m = (x[own] * w[own]).T @ x[own]
                    parts[key] = parts[key] + m if key in parts else m
        if parts:
            cols = [pa.array([key[i] for key in parts], base_types[i]) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m.ravel().tolist() for m in parts.values()], pa.list_(pa.float64()))], [*by, "_m"])

    base_types = [to_arrow_type(base.schema[c].dataType) for c in by]
    schema = StructType([*[base.schema[c] for c in by], StructField("_m", ArrayType(DoubleType()))])
    long = base.mapInArrow(run, schema).select(*by, F.posexplode("_m").alias("_p", "_v"))
    out: dict = {}
    for r in long.groupBy(*by, "_p").agg(F.sum("_v").alias("_v")).collect():  # k * k numbers per group
        out.setdefault(tuple(r[c] for c in by), np.zeros(k * k))[r["_p"]] = r["_v"]
    return {key: m.reshape(k, k) for key, m in out.items()}


def total(grams: dict) -> np.ndarray:
    return sum(grams.values())


def outer_rows(df: DataFrame, fold: str, folds: Sequence, name: str = "outer") -> DataFrame:
    """Every row once per fold it may train for, so that one grouping serves all outer folds."""
    others = F.filter(F.array(*[F.lit(k) for k in folds]), lambda k: k != F.col(fold))
    return df.withColumn(name, F.explode(others))


def leave_out(grams: dict) -> dict:
    """Matrix of all other groups, per group."""
    t = total(grams)
    return {k: t - m for k, m in grams.items()}


def solve(g: np.ndarray, ridge: np.ndarray | None = None) -> np.ndarray:
    """Least squares from a matrix whose last column is the target."""
    a, b = g[:-1, :-1].copy(), g[:-1, -1]
    if ridge is not None:
        a[np.diag_indices_from(a)] += ridge
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def design_exprs(xs: Sequence, y, intercept: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [col(x) for x in xs] + [col(y)]


def predict_by_fold(coefs: dict, xs: Sequence, fold: str = "fold", intercept: bool = True) -> Column:
    """Projection that picks the coefficients of the row's fold (literals, no join)."""
    out = {}
    for k, w in coefs.items():
        key = k[0] if isinstance(k, tuple) else k
        out[key] = linear(w[1:], xs, w[0]) if intercept else linear(w, xs)
    return by_value(fold, out)


def crossfit_ols(df: DataFrame, y: str, xs: Sequence, out: str = "pred", fold: str = "fold", fit: Column | None = None,
                 intercept: bool = True, outside: float | None = 0.0) -> DataFrame:
    """Out-of-fold least squares; ``fit`` limits both fitting and applying (``outside`` elsewhere)."""
    rows = df if fit is None else df.where(fit)
    coefs = {k: solve(g) for k, g in leave_out(gram(rows, design_exprs(xs, y, intercept), [fold])).items()}
    pred = predict_by_fold(coefs, xs, fold, intercept)
    if fit is not None:
        pred = F.when(fit, pred).otherwise(F.lit(outside))
    return df.withColumn(out, pred)
