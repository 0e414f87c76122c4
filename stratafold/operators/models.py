"""Model-backed operators: logistic gates, density ratios, calibration by source."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import average_ranks
from ..functions.scalar import by_value, clip, linear
from .folds import fold_ids, group_folds
from .gram import design_exprs, gram, leave_out, outer_rows, total
from .linear import centred_parts, ridge_coefs, ridge_nested


def _standard(df: DataFrame, xs: Sequence[str], train: Column) -> list[Column]:
    s = df.where(train).agg(*[F.avg(c).alias(f"m_{c}") for c in xs], *[F.stddev_pop(c).alias(f"s_{c}") for c in xs]).first()
    return [((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0)).alias(f"z_{c}") for c in xs]


def logistic_scores(df: DataFrame, xs: Sequence[str], label: str, train: Column, ridge: float = 0.01, out: str = "p") -> DataFrame:
    """Class probability from a ridge logistic fit on the training rows; applied to all rows as a projection."""
    d = df.select("*", *_standard(df, xs, train))
    zs = [f"z_{c}" for c in xs]
    v = VectorAssembler(inputCols=zs, outputCol="_v").transform(d)
    m = LogisticRegression(featuresCol="_v", labelCol=label, regParam=ridge, standardization=False).fit(v.where(train))
    score = linear([float(c) for c in m.coefficients], zs, float(m.intercept))
    return d.withColumn(out, 1 / (1 + F.exp(-score))).drop(*zs)


def crossfit_logistic(df: DataFrame, xs: Sequence[str], label: str, fold: str = "fold", ridge: float = 0.01, out: str = "p", steps: int = 8) -> DataFrame:
    """Out-of-fold class probability from a ridge logistic fit on standardised columns.

    Newton steps of all outer folds run together: each step is one weighted Gram per outer fold.
    """
    folds = fold_ids(df, fold)
    k = len(xs)
    scale = {f[0]: centred_parts(g) for f, g in leave_out(gram(df, design_exprs(xs, label), [fold])).items()}
    beta = {f: np.zeros(k + 1) for f in folds}

    def score(at):
        raw = {}
        for f in folds:
            w = beta[f][1:] / scale[f][2]
            raw[f] = linear(w, xs, beta[f][0] - float(w @ scale[f][1]))
        return by_value(at, raw, 0.0)

    rows = outer_rows(df, fold, folds)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-score("outer")))
        step = rows.select("outer", *xs, F.col(label).alias("_y"), p.alias("_p"))
        w = F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9))
        moved = 0.0
        for (f,), g in gram(step, [F.lit(1.0), *xs, (F.col("_y") - F.col("_p")) / w], ["outer"], w).items():
            n, mu, sd = scale[f][:3]
            t = np.eye(k + 2)  # raw columns to standardised ones
            t[0, 1:k + 1], t[range(1, k + 1), range(1, k + 1)] = -mu / sd, 1 / sd
            g = t.T @ g @ t
            pen = ridge * n * np.r_[0.0, np.ones(k)]
            d = np.linalg.solve(g[:-1, :-1] + np.diag(pen), g[:-1, -1] - pen * beta[f])
            beta[f] = beta[f] + d
            moved = max(moved, float(np.abs(d).max()))
        if moved < 1e-8:
            break
    return df.withColumn(out, 1 / (1 + F.exp(-score(fold))))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; ties count one half."""
    r = average_ranks(df.where(F.col(label).isNotNull()), list(by), score, "_r")
    pos = F.col(label) == 1
    n1, n0 = F.sum(pos.cast("double")), F.sum((~pos).cast("double"))
    s = F.sum(F.when(pos, F.col("_r")))
    return r.groupBy(*by).agg(((s - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"), F.count(F.lit(1)).alias("n"))


def density_ratio_weights(df: DataFrame, xs: Sequence[str], target: Column, lo: float = 0.1, hi: float = 10.0, ridge: float = 0.01, out: str = "w") -> DataFrame:
    """Weights that make the source rows look like the target rows: p/(1-p) n0/n1, clipped, mean 1 over the source."""
    d = df.withColumn("_t", target.cast("double"))
    n = d.agg(F.sum("_t").alias("n1"), F.sum(1 - F.col("_t")).alias("n0")).first()
    d = logistic_scores(d, xs, "_t", F.lit(True), ridge, "_p")
    w = clip(F.col("_p") / (1 - F.col("_p")) * (n["n0"] / n["n1"]), lo, hi)
    m = d.where("_t = 0").agg(F.avg(w).alias("m")).first()["m"]
    return d.withColumn(out, F.when(F.col("_t") == 0, w / m)).drop("_t", "_p")


# ---------------------------------------------------------------- calibration of degraded measures
def calibrate(pairs: DataFrame, xs: Sequence[str], y: str, source: str, apply_to: DataFrame, alphas: Sequence[float], key: str, k: int = 5,
              weight: str | None = None, out: str = "cal") -> DataFrame:
    """Maps degraded measures to clean values. Folds never split a source: the rows of a source in the pairs get the model
    that has not seen it, all other rows the mean over the models.
    """
    folds = group_folds(pairs.select(source).distinct(), source, k)
    gs = gram(pairs.join(folds, source), design_exprs(xs, y), ["fold"], weight)
    fits = {f[0]: v[1] for f, v in ridge_nested(gs, alphas).items()}
    own = by_value("fold", {f: linear(w[1:], xs, w[0]) for f, w in fits.items()})
    mean = sum((linear(w[1:], xs, w[0]) for w in fits.values()), F.lit(0.0)) / len(fits)
    j = apply_to.join(folds.withColumnRenamed(source, key), key, "left")
    return j.withColumn(out, F.coalesce(F.when(F.col("fold").isNotNull(), own), mean))


def calibrate_banded(pairs: DataFrame, xs: Sequence[str], y: str, source: str, quality: str, edges: Sequence[float], margin: float, apply_to: DataFrame,
                     alpha: float, key: str, weight: str | None = None, k: int = 5, out: str = "cal") -> DataFrame:
    """One calibration per quality band: fitted on bands widened by the margin, applied on the exact bands.

    A pair row may feed several widened bands; all (fold, band) statistics come from one Gram.
    """
    from .columns import band_masks

    folds = group_folds(pairs.select(source).distinct(), source, k)
    masks = band_masks(quality, edges, margin)
    member = F.array_compact(F.array(*[F.when(fit, F.lit(b)) for b, (fit, _) in enumerate(masks)]))
    gs = gram(pairs.join(folds, source).withColumn("band", F.explode(member)), design_exprs(xs, y), ["fold", "band"], weight)
    j = apply_to.join(folds.withColumnRenamed(source, key), key, "left")
    preds = F.lit(None).cast("double")
    for b, (_, apply) in enumerate(masks):
        own_gs = {(f,): g for (f, band), g in gs.items() if band == b}
        if not own_gs:
            continue
        fits = {f[0]: ridge_coefs(g, [alpha])[0] for f, g in leave_out(own_gs).items()}
        full = ridge_coefs(total(own_gs), [alpha])[0]
        own = by_value("fold", {f: linear(w[1:], xs, w[0]) for f, w in fits.items()})
        preds = F.when(apply, F.coalesce(F.when(F.col("fold").isNotNull(), own), linear(full[1:], xs, full[0]))).otherwise(preds)
    return j.withColumn(out, preds)
