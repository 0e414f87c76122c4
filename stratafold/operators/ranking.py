"""Ranks, top-k, picks and correlations of ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import safe_corr
from ..functions.ranks import row_numbers, running_sums
from ..session import written

ROWS = 1 << 19  # rows of one partition that meet their ranks


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in cols], name, value)


def spearman_grid(df: DataFrame, cols: Sequence[str], targets: Sequence[str], subsets: dict) -> DataFrame:
    """Average-rank correlations of all columns with all targets on all subsets: (subset, target, feature, rho, n).

    Only distinct values are ranked. A row meets the ranks of its target once, whatever the columns: columns without NULLs share them,
    another column has ranks over its own complete rows. The rows of one value of a column then travel as their count and the sums of
    their target ranks, so no row is copied per column into a shuffle and no task holds the rows of a frequent value.
    """
    holes = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-holes["n"] * len(targets) // ROWS))
    full = [i for i in range(len(cols)) if not holes[f"h{i}"]]
    kinds = [k for k in (full, *[[i] for i in range(len(cols)) if holes[f"h{i}"]]) if k]  # columns whose complete rows are the same
    groups = [(s, k) for s in subsets for k in kinds]
    inside = [F.coalesce(subsets[s], F.lit(False)) if not holes[f"h{k[0]}"] else F.coalesce(subsets[s], F.lit(False)) & F.col(cols[k[0]]).isNotNull() for s, k in groups]
    y = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_t{j}").alias("_y")) for j, t in enumerate(targets)]))
    d = df.select(*[m.alias(f"_in{g}") for g, m in enumerate(inside)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
                  *[F.col(t).cast("double").alias(f"_t{j}") for j, t in enumerate(targets)])
    members, values = [f"_in{g}" for g in range(len(groups))], [f"_x{i}" for i in range(len(cols))]
    d = d.where(" or ".join(members)).select(*members, *values, y).where("_y is not null")
    counts = d.groupBy("target", "_y").agg(*[F.count(F.when(F.col(m), 1)).alias(f"_n{g}") for g, m in enumerate(members)])
    order = running_sums(counts, ["target"], ["_y"], {f"_n{g}": F.col(f"_n{g}") for g in range(len(groups))})
    centred = lambda n: F.col(f"{n}_before") + (F.col(n) - F.col(f"{n}_total")) / 2  # noqa: E731  average rank less the mean of all ranks
    ranks = order.select("target", "_y", *[centred(f"_n{g}").alias(f"_r{g}") for g in range(len(groups))])
    cells = [F.when(F.col(f"_in{g}"), F.struct(F.lit(s).alias("subset"), F.lit(cols[i]).alias("feature"), F.col(f"_x{i}").alias("value"), F.col(f"_r{g}").alias("r")))
             for g, (s, k) in enumerate(groups) for i in k]
    met = d.repartition(parts, "target", "_y").join(ranks, ["target", "_y"]).select("target", F.inline(F.array_compact(F.array(*cells))))
    keys = ["subset", "target", "feature"]
    sums = met.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sy"), F.sum(F.col("r") * F.col("r")).alias("syy"))
    x = running_sums(written(sums, "rank-sums"), keys, ["value"], {"n": F.col("n")}).withColumn("r", centred("n"))
    x = x.groupBy(*keys).agg(F.sum(F.col("n") * F.col("r") * F.col("r")).alias("xx"), F.sum("syy").alias("yy"), F.sum(F.col("r") * F.col("sy")).alias("xy"), F.sum("n").alias("n"))
    sd = F.sqrt("xx") * F.sqrt("yy")
    return x.select(*keys, F.when(sd > 0, F.col("xy") / sd).alias("rho"), "n")


def spearman(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Average-rank correlation of every column with the target over complete pairs: (feature, rho, n)."""
    return spearman_grid(df, cols, [y], {"all": F.lit(True)}).select("feature", "rho", "n")


def top_by_abs(df: DataFrame, c: str, n: int, tie: str) -> DataFrame:
    """Spark runs this as a per-partition top-n followed by a merge; no global sort."""
    return df.orderBy(F.abs(c).desc(), tie).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows of each group; Spark limits each partition before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn.cast("int")).where(F.col("rn") <= n)


def drop_top(df: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    """All rows but the n with the smallest score."""
    worst = df.select(tie, score).orderBy(score, tie).limit(n).select(tie)
    return df.join(worst, tie, "left_anti")


def pick_best(scores: DataFrame, keys: Sequence[str], option: str, score: str, order: str) -> DataFrame:
    """Lowest score per key; equal scores go to the option declared first."""
    return scores.groupBy(*keys).agg(
        F.min_by(F.col(option), F.struct(F.col(score), F.col(order))).alias("pick"), F.min(score).alias("score"))


def most_frequent(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).count().orderBy(F.desc("count"), c).limit(1)


def evenly_spaced(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows at evenly spaced positions of the sorted column (first and last included)."""
    r = row_numbers(df, [], [by, key], "rn")
    total = df.count()
    at = sorted({round(i * (total - 1) / (n - 1)) + 1 for i in range(n)})
    return r.where(F.col("rn").isin(at))


def share_position(df: DataFrame, keys: Sequence[str], order: Sequence, weight: str) -> DataFrame:
    """Adds the share of the group's weight before each row in the given order."""
    r = running_sums(df, keys, order, {"_w": F.col(weight)})
    return r.withColumn("share_before", F.col("_w_before") / F.col("_w_total"))


def lag_correlation(df: DataFrame, key: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation in key order at each lag.

    Rows get their position from a bucketed numbering and meet their successor by an equi-join on
    the position, so no task ever holds the whole sequence.
    """
    r = row_numbers(df.select(key, value), [], [key], "_rn").select("_rn", F.col(value).alias("_a"))
    later = r.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).select((F.col("_rn") - F.col("lag")).alias("_rn"), "lag", F.col("_a").alias("_b"))
    return r.join(later, "_rn").groupBy("lag").agg(safe_corr("_a", "_b").alias("ac"), F.count(F.lit(1)).alias("n"))


def missing_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys absent from the dense sequence first..last."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    return df.sparkSession.range(lo, hi + 1).withColumnRenamed("id", key).join(df.select(key), key, "left_anti")


def permute_blocks(blocks: DataFrame, maps: dict[int, Sequence[int]], key: str = "id") -> DataFrame:
    """Block values under every index permutation: row (id, k, blk) holds the value of block maps[k][blk]."""
    out = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(j).alias("blk"), F.lit(int(src)).alias("src"))
                    for k, m in maps.items() for j, src in enumerate(m)])
    per_src = F.filter(out, lambda s: s["src"] == F.col("_b"))
    return blocks.select(key, F.col("blk").alias("_b"), "meas").select(key, "meas", F.explode(per_src).alias("t")).select(
        key, "t.k", F.col("t.blk").alias("blk"), "meas")


def dihedral_maps(side: int) -> dict[int, list[int]]:
    """The eight symmetries of a side x side grid: maps[k][j] is the source index of target j."""
    n = side - 1
    pos = [lambda y, x: (y, x), lambda y, x: (x, n - y), lambda y, x: (n - y, n - x), lambda y, x: (n - x, y),
           lambda y, x: (y, n - x), lambda y, x: (n - y, x), lambda y, x: (x, y), lambda y, x: (n - x, n - y)]
    return {k: [f(j // side, j % side)[0] * side + f(j // side, j % side)[1] for j in range(side * side)] for k, f in enumerate(pos)}


def binned_squares(df: DataFrame, x: str, r: str, n: int) -> DataFrame:
    """Mean and standard error of the squared residual per quantile bin."""
    from .metrics import quantile_bin

    sq = F.pow(F.col(r), 2)
    b = df.withColumn("qbin", quantile_bin(df, x, n))
    return b.groupBy("qbin").agg(F.avg(x).alias("x_mean"), F.avg(sq).alias("r2_mean"),
                                 (F.stddev_samp(sq) / F.sqrt(F.count(sq))).alias("r2_sem"), F.count(sq).alias("size"))


def median_by_weight(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Smallest value whose cumulative weight share reaches one half."""
    from ..functions.ranks import value_ranks

    r = value_ranks(df, keys, value, weight)
    hit = F.col("w_before") + F.col("w") >= 0.5 * F.col("w_total")
    return r.groupBy(*keys).agg(F.min(F.when(hit, F.col(value))).alias("wmed"))
