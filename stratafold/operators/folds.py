"""Fold assignment: stratified K-fold, stratified re-splits, grouped K-fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import global_quantiles, null_safe_join, row_numbers
from ..functions.scalar import cut, md5_order, md5_uniform


def stratified_folds(df: DataFrame, key: str, y: str, n_bins: int = 10, k: int = 5, seed: int | None = None,
                     thin: int | None = None) -> DataFrame:
    """Quantile bins of the target, then the rows of each bin are dealt to the folds in turn.

    ``seed=None`` deals in key order; a seed deals in hash order. Adds ``bin`` and ``fold``. Rows with a
    NULL target form a bin of their own (``bin`` NULL) and are dealt like the others.
    """
    edges = global_quantiles(df, y, [i / n_bins for i in range(1, n_bins)], thin)
    b = df.withColumn("bin", cut(y, edges))
    order = [key] if seed is None else [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    numbered = row_numbers(b, ["bin"], order, "_rn", thin)
    return numbered.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def stratified_resplits(df: DataFrame, key: str, stratum: str, n: int, k: int = 5, seed: int = 0) -> DataFrame:
    """``n`` re-splits as rows (split, fold): each stratum is shuffled by hash and dealt with an offset."""
    long = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = [md5_order(seed, F.col("split"), F.col(key)), F.col(key)]
    numbered = row_numbers(long, ["split", stratum], order, "_rn")
    shift = F.floor(md5_uniform(seed, F.col("split"), F.col(stratum)) * k)
    return numbered.withColumn("fold", ((F.col("_rn") + shift) % k).cast("int")).drop("_rn")


def group_folds(df: DataFrame, source: str, k: int = 5, thin: int | None = None) -> DataFrame:
    """Every row of one source gets the same fold; sources are dealt in key order, NULL as a source of its own."""
    src = row_numbers(df.select(source).distinct(), [], [source], "_rn", thin)
    src = src.select(source, ((F.col("_rn") - 1) % k).cast("int").alias("fold"))
    return null_safe_join(df, src, [source])


def fold_ids(df: DataFrame, fold: str = "fold") -> Sequence:
    """Distinct fold labels; a handful of values by construction."""
    return sorted(r[0] for r in df.select(fold).distinct().collect())
