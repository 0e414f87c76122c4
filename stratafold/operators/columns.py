"""Projections: column selection, null policy, gates, interactions, clips and row replacement.

Statistics that come from training rows (medians, cuts, maxima) are a few numbers per column;
they are computed by one aggregate and put back as literals, so the projection itself needs
no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import column_quantiles, global_quantiles, running_sums
from ..functions.scalar import by_value, clip, col, digitize, finite, ramp, signed_log, signed_sqrt

PRESETS: dict[str, list[str]] = {"shape": [r"^x[123]$", r"^q\d$"]}


def select_columns(df: DataFrame, keep=None, drop=None, key: str = "id") -> DataFrame:
    """Keep columns matching any pattern (or a named preset), then drop matches of ``drop``."""
    pats = PRESETS.get(keep, keep) if isinstance(keep, str) else keep
    cols = [c for c in df.columns if c != key and (not pats or any(re.search(p, c) for p in pats))]
    cols = [c for c in cols if not (drop and re.search(drop, c))]
    return df.select(key, *cols)


def copy_columns(df: DataFrame, cols: Sequence[str], prefix: str, key: str = "id") -> DataFrame:
    return df.select(key, *[F.col(c).alias(prefix + c) for c in cols])


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.expr("stack(%d, %s) as (feature, value)" % (
        len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))))


def leave_out_quantiles(df: DataFrame, cols: Sequence[str], fold: str, folds: Sequence, probs: Sequence[float]) -> dict:
    """Quantiles of every column over all rows outside each fold: {column: {fold: [values]}}.

    Distinct values carry one count per fold; "outside fold k" is the total count minus that
    of fold k, so the rows are scanned and shuffled once for all folds.
    """
    pre = _long(df, [fold], cols).where("value is not null").groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(fold) == F.lit(k), 1)).alias(f"f{i}") for i, k in enumerate(folds)])
    sums = {f"n{i}": F.col("n") - F.col(f"f{i}") for i, _ in enumerate(folds)}
    r = running_sums(pre, ["feature"], ["value"], sums)
    aggs = []
    for i, _ in enumerate(folds):
        before, here, tot = F.col(f"n{i}_before"), sums[f"n{i}"], F.col(f"n{i}_total")
        aggs.append(F.max(tot).alias(f"t{i}"))
        for q, p in enumerate(probs):
            pos = F.lit(float(p)) * (tot - 1)
            for tag, k in (("a", F.floor(pos)), ("b", F.ceil(pos))):
                aggs.append(F.max(F.when((before <= k) & (k < before + here), F.col("value"))).alias(f"{tag}{i}_{q}"))
    out: dict = {c: {} for c in cols}
    for row in r.groupBy("feature").agg(*aggs).collect():
        for i, k in enumerate(folds):
            vals = []
            for q, p in enumerate(probs):
                pos = p * (row[f"t{i}"] - 1)
                a, b = row[f"a{i}_{q}"], row[f"b{i}_{q}"]
                vals.append(a + (pos - int(pos)) * (b - a))
            out[row["feature"]][k] = vals
    return out


def leave_out_medians(df: DataFrame, cols: Sequence[str], fold: str, folds: Sequence) -> dict:
    q = leave_out_quantiles(df, cols, fold, folds, [0.5])
    return {c: {k: v[0] for k, v in per.items()} for c, per in q.items()}


def fold_standard_stats(df: DataFrame, cols: Sequence[str], fold: str, folds: Sequence) -> dict:
    """{column: {fold: (median, mean, sd)}} from the rows outside each fold, after median imputation."""
    med = leave_out_medians(df, cols, fold, folds)
    aggs = []
    for c in cols:
        aggs += [F.count(F.lit(1)).alias("_n"), F.sum(F.isnull(c).cast("bigint")).alias(f"m_{c}"),
                 F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{c}"),
                 F.coalesce(F.sum(col(c) * col(c)), F.lit(0.0)).alias(f"q_{c}")]
    per = {r[fold]: r for r in df.groupBy(fold).agg(aggs[0], *[a for i, a in enumerate(aggs) if i % 4]).collect()}
    out: dict = {c: {} for c in cols}
    for c in cols:
        for k in folds:
            m = med[c][k]
            rows = [per[j] for j in folds if j != k]
            n = sum(r["_n"] for r in rows)
            s = sum(r[f"s_{c}"] + r[f"m_{c}"] * m for r in rows)
            q = sum(r[f"q_{c}"] + r[f"m_{c}"] * m * m for r in rows)
            var = max(q - s * s / n, 0.0) / (n - 1)
            sd = var ** 0.5 if var > 1e-18 else 1.0
            out[c][k] = (m, s / n, sd)
    return out


def standardise_in_fold(df: DataFrame, cols: Sequence[str], fold: str = "fold", prefix: str = "z_") -> DataFrame:
    """Impute by median and standardise every row with the statistics of the other folds."""
    from .folds import fold_ids

    stats = fold_standard_stats(df, cols, fold, fold_ids(df, fold))
    new = []
    for c in cols:
        m, mu, sd = ({k: v[i] for k, v in stats[c].items()} for i in range(3))
        new.append(((F.coalesce(col(c), by_value(fold, m)) - by_value(fold, mu)) / by_value(fold, sd)).alias(prefix + c))
    return df.select("*", *new)


def scale_columns(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Multiply standardised columns: the penalty on a column becomes alpha / scale^2."""
    return df.withColumns({c: F.col(c) * s for c, s in scales.items()})


def band_columns(df: DataFrame, cols: Sequence[str], quality: str, train: Column, lo: float, hi: float | None,
                 prefix: str, key: str = "id") -> DataFrame:
    """Keep values only where ``lo-quantile < quality <= hi-quantile`` (cuts from training rows)."""
    cuts = global_quantiles(df.where(train), quality, [lo] + ([hi] if hi is not None else []))
    keep = F.col(quality) > cuts[0]
    if hi is not None:
        keep = keep & (F.col(quality) <= cuts[1])
    return df.select(key, *[F.when(keep, F.col(c)).alias(prefix + c) for c in cols])


def ramp_interaction(df: DataFrame, cols: Sequence[str], quality: str, train: Column, prefix: str = "rmp_",
                     key: str = "id") -> DataFrame:
    c1, c2 = global_quantiles(df.where(train), quality, [1 / 3, 2 / 3])
    t = ramp(quality, c1, c2)
    return df.select(key, *[(F.col(c) * t).alias(prefix + c) for c in cols], t.alias(prefix + "t"))


def z_interaction(df: DataFrame, cols: Sequence[str], quality: str, train: Column, prefix: str = "zi_",
                  key: str = "id") -> DataFrame:
    s = df.where(train).agg(F.avg(quality).alias("m"), F.stddev_samp(quality).alias("s")).first()
    t = (F.col(quality) - s["m"]) / s["s"]
    return df.select(key, *[(F.col(c) * t).alias(prefix + c) for c in cols], t.alias(prefix + "t"))


def soft_gate(df: DataFrame, cols: Sequence[str], quality: str, start: float, width: float, key: str = "id") -> DataFrame:
    g = clip((F.col(quality) - start) / width, 0.0, 1.0)
    return df.select(key, g.alias("gate"), *[F.when(g > 0, g * F.col(c)).otherwise(0.0).alias("g_" + c) for c in cols])


def gated_member_columns(df: DataFrame, gate: DataFrame, h: str, n: str, key: str = "id", tree: bool = False) -> DataFrame:
    """gate, gate*h, gate*n^0.25: 0 outside the gate for linear models, NULL for tree models."""
    g = gate.select(key, F.col(h).alias("_h"), F.col(n).alias("_n"), F.lit(1.0).alias("_g"))
    j = df.join(g, key, "left")
    fill = F.lit(None).cast("double") if tree else F.lit(0.0)
    inside = F.col("_g").isNotNull()
    return j.select(key, F.when(inside, 1.0).otherwise(0.0).alias("gate"),
                    F.when(inside, F.col("_h")).otherwise(fill).alias("gate_h"),
                    F.when(inside, F.pow("_n", F.lit(0.25))).otherwise(fill).alias("gate_n"))


def group_columns(df: DataFrame, cols: Sequence[str], quality: str, train: Column, probs: Sequence[float],
                  key: str = "id") -> DataFrame:
    """Group = number of training cuts exceeded; columns are repeated per group, NULL in the others."""
    cuts = global_quantiles(df.where(train), quality, probs)
    g = sum((F.when(F.col(quality) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    out = [F.when(g == k, F.col(c)).alias(f"{c}_own{k}") for k in range(1, len(cuts) + 1) for c in cols]
    return df.select(key, g.cast("int").alias("grp"), *[F.col(c) for c in cols], *out)


def stratum(noise: str, ratio: str, lo: float, mid: float, cut_ratio: float) -> Column:
    """Five-way label from a noise level and a quality ratio."""
    high = F.col(ratio) >= cut_ratio
    return (F.when(F.col(noise) < lo, "clean")
            .when((F.col(noise) < mid) & high, "LV").when(F.col(noise) < mid, "midLF")
            .when(high, "HLV").otherwise("G1hi"))


def above_train_medians(df: DataFrame, cols: Sequence[str], train: Column) -> Column:
    """True where every column is above its training median."""
    med = column_quantiles(df.where(train), cols, [0.5])
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(c) > med[c][0])
    return cond


def band_masks(quality: str, edges: Sequence[float], margin: float) -> list[tuple[Column, Column]]:
    """(fit, apply) masks per band: fit bands are widened by the margin, apply bands tile the line."""
    bounds = [float("-inf"), *edges, float("inf")]
    q = F.col(quality)
    return [((q >= lo - margin) & (q < hi + margin), (q >= lo) & (q < hi)) for lo, hi in zip(bounds, bounds[1:])]


def signed_transforms(df: DataFrame, cols: Sequence[str], key: str = "id") -> DataFrame:
    return df.select(key, *[signed_log(c).alias("sl_" + c) for c in cols], *[signed_sqrt(c).alias("ss_" + c) for c in cols])


def log_if_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Log of a column only when all its values are positive."""
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.log(c) for c in cols if low[c] is not None and low[c] > 0})


def clip_to_train(df: DataFrame, c: str, train: Column) -> Column:
    """Clip to the largest absolute value seen on the training rows."""
    m = df.where(train).agg(F.max(F.abs(c)).alias("m")).first()["m"]
    return clip(c, -float(m), float(m))


def replace_rows(base: DataFrame, changed: DataFrame, value: str = "pred", key: str = "id") -> DataFrame:
    """New values for the keys in ``changed``; every other row keeps its bits."""
    new = changed.select(key, F.col(value).alias("_new"))
    return base.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def convex_mix(base, other, share) -> Column:
    return col(base) + share * (col(other) - col(base))


def key_parts(key: str) -> list[Column]:
    k = F.col(key)
    return [F.split(k, "_")[0].alias("prefix"), F.regexp_extract(k, r"(\d+)$", 1).cast("bigint").alias("num"),
            F.regexp_replace(k, r"\D", "").cast("bigint").alias("seed"), k.startswith("TRAIN").alias("is_train")]


def design(df: DataFrame, variants: dict[str, list[Callable[[], Column]]], name: str, key: str = "id") -> DataFrame:
    """Columns of one named design variant."""
    return df.select(key, *[f().alias(f"d{i}") for i, f in enumerate(variants[name])])


def bin_index(c: str, edges: Sequence[float]) -> Column:
    return digitize(c, edges)
