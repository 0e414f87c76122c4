"""Error metrics, binned profiles and summaries of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import column_quantiles, global_quantiles, null_safe_join, quantiles
from ..functions.scalar import by_value, col, cut, digitize


def rmse(pred, y) -> Column:
    d = col(pred) - col(y)
    return F.sqrt(F.avg(d * d))


def safe_div(a, b) -> Column:
    """NULL instead of an error when the divisor is zero."""
    b = col(b)
    return F.when(b != 0, col(a) / b)


def safe_corr(a, b) -> Column:
    """Pearson correlation over complete pairs; NULL when either side is constant."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    sd = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.when(sd > 0, F.covar_pop(a, b) / sd)


def rmse_by(df: DataFrame, pred: str, y: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """RMSE and count for several groupings in one pass (GROUPING SETS); NULL marks "all"."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    names = [df.select(*s).columns for s in sets]
    return df.groupingSets([[F.col(c) for c in s] for s in names], *[F.col(k) for k in keys]).agg(
        rmse(pred, y).alias("rmse"), F.count(F.lit(1)).alias("n"))


def tercile(df: DataFrame, c: str, train: Column | None = None) -> Column:
    """Left-closed tercile index with cuts from the training rows."""
    return digitize(c, global_quantiles(df if train is None else df.where(train), c, [1 / 3, 2 / 3]))


def quantile_bin(df: DataFrame, c: str, n: int) -> Column:
    """Right-closed equal-count bins."""
    return cut(c, global_quantiles(df, c, [i / n for i in range(1, n)]))


def profile(df: DataFrame, keys: Sequence[str], pred: str, y: str, c: str) -> DataFrame:
    """Per bin: n, median of the covariate, RMSE, spreads, mean residual, correlation."""
    r = F.col(y) - F.col(pred)
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rmse(pred, y).alias("rmse"), F.stddev_samp(y).alias("y_sd"), F.stddev_samp(pred).alias("pred_sd"),
        F.avg(y).alias("y_mean"), F.avg(r).alias("resid_mean"), safe_corr(pred, y).alias("corr"))
    return null_safe_join(a, quantiles(df, keys, c, {"med": 0.5}).select(*keys, "med"), list(keys), "left")


def band_summary(df: DataFrame, keys: Sequence[str], means: Sequence[str], medians: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    for c in medians:
        out = null_safe_join(out, quantiles(df, keys, c, {f"med_{c}": 0.5}).drop("n_total"), list(keys), "left")
    return out


def wmean(v, w) -> Column:
    return F.sum(col(v) * col(w)) / F.sum(F.when(col(v).isNotNull(), col(w)))


def wrms(v, w) -> Column:
    return F.sqrt(wmean(col(v) * col(v), w))


def wsd(v, w) -> Column:
    m = wmean(v, w)
    return F.sqrt(F.greatest(F.lit(0.0), wmean(col(v) * col(v), w) - m * m))


def effective_size(w) -> Column:
    return F.sum(col(w)) * F.sum(col(w)) / F.sum(col(w) * col(w))


def multiplicity(df: DataFrame, c: str, digits: Sequence[int]) -> DataFrame:
    """Largest count of one rounded value, and the number of distinct ones, per precision."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(d).alias("digits"), F.round(c, d).alias("v")) for d in digits])))
    per = long.groupBy("digits", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("digits").agg(F.max("n").alias("max_n"), F.count(F.lit(1)).alias("n_distinct"))


def lattice_power(df: DataFrame, c: str, spacings: Sequence[float]) -> DataFrame:
    """|mean exp(2 pi i y / d)| per spacing; all spacings are columns of one aggregate."""
    aggs = []
    for i, d in enumerate(spacings):
        a = 2 * F.pi() * F.col(c) / d
        aggs += [F.avg(F.cos(a)).alias(f"c{i}"), F.avg(F.sin(a)).alias(f"s{i}")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(float(d)).alias("spacing"), F.sqrt(F.col(f"c{i}") ** 2 + F.col(f"s{i}") ** 2).alias("power"))
        for i, d in enumerate(spacings)])))


def kde(df: DataFrame, keys: Sequence[str], c: str, grid: Sequence[float], bandwidth: float, digits: int | None = None) -> DataFrame:
    """Gaussian kernel density at fixed grid points: (keys, i, x, dens, peak).

    Equal values are collapsed first; the distinct values meet the fixed grid and combine on the map side.
    """
    v = df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    norm = 1.0 / (bandwidth * (2 * 3.141592653589793) ** 0.5)
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("x")) for i, g in enumerate(grid)])
    k = F.col("_n") * F.exp(-F.pow((F.col("x") - F.col("_v")) / bandwidth, 2) / 2)
    d = v.select(*keys, "_v", "_n", F.inline(points)).groupBy(*keys, "i", "x").agg((F.sum(k) * norm / F.sum("_n")).alias("dens"))
    line = W.partitionBy(*(keys or [F.lit(0)])).orderBy("i")  # one row per grid point
    peak = (F.col("dens") > F.lag("dens").over(line)) & (F.col("dens") > F.lead("dens").over(line))
    return d.withColumn("peak", F.coalesce(peak, F.lit(False)))


def gate_counts(df: DataFrame, group: str, split: Column, gate: Column) -> DataFrame:
    """Pass counts by group and split with rates and a two-sided Fisher exact p per group."""
    c = lambda cond: F.count(F.when(cond, 1))
    t = df.groupBy(group).agg(
        c(~split & gate).alias("train_pass"), c(~split).alias("train_n"), c(split & gate).alias("test_pass"), c(split).alias("test_n"))
    return t.withColumns({"train_rate": safe_div("train_pass", "train_n"), "test_rate": safe_div("test_pass", "test_n")})


def fisher_exact(a: int, b: int, c: int, d: int, block: int = 1 << 16) -> float:
    """Two-sided Fisher p of [[a, b], [c, d]]: the share of all tables with these margins that are at most as likely.

    Probabilities are walked outward from the most likely table by the ratio of neighbours, in blocks of fixed size, until they add
    nothing to the answer; no factorial is taken and no term is left out.
    """
    r1, r2, c1 = a + b, c + d, a + c
    lo, hi = max(0, c1 - r2), min(r1, c1)
    if lo == hi:
        return 1.0
    mode = min(hi, max(lo, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)))

    def walk(step: int):
        """(first place, probabilities relative to the mode) block by block."""
        k, t, end = mode, 1.0, hi if step > 0 else lo
        while k != end and t > 0:
            ks = k + step * np.arange(min(block, abs(end - k)), dtype=np.float64)
            if step > 0:
                ratio = (r1 - ks) * (c1 - ks) / ((ks + 1) * (r2 - c1 + ks + 1))
            else:
                ratio = ks * (r2 - c1 + ks) / ((r1 - ks + 1) * (c1 - ks + 1))
            terms = t * np.cumprod(ratio)
            yield k + step, terms
            k, t = k + step * len(ks), float(terms[-1])

    seen = 1.0 if a == mode else 0.0
    step = 1 if a > mode else -1
    if a != mode:
        for first, terms in walk(step):
            if abs(a - first) < len(terms):
                seen = float(terms[abs(a - first)])
                break
    if seen == 0.0:
        return 0.0  # below the smallest positive number
    cut, total = seen * (1 + 1e-7), 1.0
    tail = 1.0 if cut >= 1 else 0.0
    for step in (1, -1):
        for _, terms in walk(step):
            total += float(terms.sum())
            tail += float(terms[terms <= cut].sum())
            if terms[-1] < seen * 1e-18:
                break
    return min(1.0, tail / total)


def fisher_p(a, b, c, d) -> Column:
    """``fisher_exact`` of count columns; 1 where a table is empty, NULL where a count is."""
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        gap = a.isna() | b.isna() | c.isna() | d.isna()
        return pd.Series([None if g else fisher_exact(*map(int, t)) for g, *t in zip(gap, a, b, c, d)], dtype="float64")

    return p(*[col(x).cast("long") for x in (a, b, c, d)])


def checksums(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(c, digits)).alias(f"sum_{c}") for c in cols],
                  *[F.sum(F.isnull(c).cast("bigint")).alias(f"null_{c}") for c in cols])


def average_readers(files: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    out = files[0].select(key, value)
    for f in files[1:]:
        out = out.unionByName(f.select(key, value))
    return out.groupBy(key).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_readers"))


def combine_folds(preds: DataFrame, own_fold: DataFrame, key: str, model_fold: str, value: str) -> DataFrame:
    """Training rows take only their own fold's model; other rows average all models; tag the source.

    ``own_fold`` has (key, fold) with NULL for rows outside training.
    """
    j = own_fold.join(preds, key, "left")
    own = F.max(F.when(F.col("fold") == F.col(model_fold), F.col(value)))
    g = j.groupBy(key, "fold").agg(own.alias("_own"), F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    train = F.col("fold").isNotNull()
    return g.select(key, F.when(train, F.col("_own")).otherwise(F.col("_mean")).alias(value),
                    F.when(train & F.col("_own").isNull(), "none").when(train, F.concat(F.lit("oof"), F.col("fold").cast("string")))
                    .otherwise(F.concat(F.lit("mean"), F.col("_n").cast("string"))).alias("src"))


def shift_profile(df: DataFrame, cols: Sequence[str], test: Column) -> DataFrame:
    """Medians of both splits and the standardised mean difference per column."""
    from .ranking import unpivot

    long = unpivot(df.withColumn("_t", test), ["_t"], cols).where("value is not null")
    mom = long.groupBy("feature").agg(
        F.avg(F.when(~F.col("_t"), F.col("value"))).alias("m0"), F.avg(F.when(F.col("_t"), F.col("value"))).alias("m1"),
        F.stddev_samp(F.when(~F.col("_t"), F.col("value"))).alias("s0"))
    med = quantiles(long, ["feature", "_t"], "value", {"q": 0.5}).groupBy("feature").agg(
        F.max(F.when(~F.col("_t"), F.col("q"))).alias("train_med"), F.max(F.when(F.col("_t"), F.col("q"))).alias("test_med"))
    return mom.join(med, "feature").select("feature", "train_med", "test_med", safe_div(F.col("m1") - F.col("m0"), "s0").alias("smd"))


def bin_shares(df: DataFrame, cols: Sequence[str], test: Column) -> DataFrame:
    """Share of each tercile (training cuts) in both splits."""
    cuts = column_quantiles(df.where(~test), cols, [1 / 3, 2 / 3])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), digitize(c, cuts[c]).alias("bin")) for c in cols])
    long = df.select(test.alias("is_test"), F.inline(cells))
    n = {r["t"]: r["n"] for r in df.groupBy(test.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    g = long.groupBy("feature", "is_test", "bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select("feature", "is_test", "bin", (F.col("n") / by_value("is_test", {k: float(v) for k, v in n.items()}, 1.0)).alias("share"))


def variant_stability(long: DataFrame, key: str, value: str) -> DataFrame:
    return long.groupBy(key).agg(F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("rng"), F.avg(value).alias("mean"))


def variant_contrast(long: DataFrame, key: str, variant: str, value: str, fine: Sequence, coarse: Sequence) -> DataFrame:
    f = F.avg(F.when(F.col(variant).isin(list(fine)), F.col(value)))
    c = F.avg(F.when(F.col(variant).isin(list(coarse)), F.col(value)))
    return long.groupBy(key).agg((f - c).alias("contrast"))
