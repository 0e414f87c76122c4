"""Two-level aggregation: pixels to cells to blocks to entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import col
from .metrics import safe_div, wmean


def with_region_area(px: DataFrame, label: str = "lab") -> DataFrame:
    """Each pixel with the size of its region; the window reuses the image partitioning."""
    return px.withColumn("a", F.count(F.lit(1)).over(W.partitionBy("img", label)).cast("double"))


def grid_index(size: int, cells: int) -> Column:
    step = size // cells
    return (F.floor(F.col("y") / step) * cells + F.floor(F.col("x") / step)).cast("int")


def block_power_mean(px: DataFrame, valid: Column, size: int, cells: int, p: float = 0.5, least: int = 1) -> DataFrame:
    """-(1/p) log(mean a^-p) over the valid pixels of each block; NULL with too few of them."""
    m = F.avg(F.when(valid, F.pow("a", F.lit(-p))))
    n = F.sum(valid.cast("int"))
    return px.groupBy("img", grid_index(size, cells).alias("blk")).agg(F.when(n >= least, -(1 / p) * F.log(m)).alias("b"))


def block_unit_mean(px: DataFrame, valid: Column, label: str, size: int, cells: int, least: int = 1) -> DataFrame:
    """Same with every region of the block counted once."""
    per = px.groupBy("img", grid_index(size, cells).alias("blk"), label).agg(
        F.max("a").alias("a"), F.sum(valid.cast("int")).alias("n"))
    n = F.sum("n")
    return per.groupBy("img", "blk").agg(F.when(n >= least, -2 * F.log(F.avg(F.when(F.col("n") > 0, F.pow("a", F.lit(-0.5)))))).alias("b"))


def dispersion(blocks: DataFrame, value: str, key: str = "img") -> DataFrame:
    """Population sd and 1.4826 x MAD over the few blocks of an image."""
    g = blocks.groupBy(key).agg(F.stddev_pop(value).alias("sd"), F.percentile(value, 0.5).alias("_m"), F.collect_list(value).alias("_v"))
    dev = F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("_m"))))
    n = F.size("_v")
    lo, hi = F.get(dev, F.floor((n - 1) / 2).cast("int")), F.get(dev, F.ceil((n - 1) / 2).cast("int"))
    return g.select(key, "sd", (1.4826 * (lo + hi) / 2).alias("mad"))


def cells_to_blocks(cells: DataFrame, per_side: int, group: int) -> DataFrame:
    """Block value from its cells: -2 log(mean exp(-b/2)); empty cells are skipped."""
    cy, cx = F.floor(F.col("blk") / per_side), F.col("blk") % per_side
    blk = (F.floor(cy / group) * (per_side // group) + F.floor(cx / group)).cast("int")
    return cells.groupBy("img", blk.alias("blk")).agg((-2 * F.log(F.avg(F.exp(-F.col("b") / 2)))).alias("b"))


def map_stats(blocks: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Mean, sd, quantiles and spreads of the block map of each entity (a fixed number of blocks)."""
    nz = (F.col("by") % 2 == 0) & (F.col("bx") % 2 == 0)
    v4 = F.when(nz, F.col(value))
    names = ["q0", "q10", "q25", "q50", "q75", "q90", "q100"]
    g = blocks.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)])).alias("_q"),
        F.stddev_pop(v4).alias("sd4"), (F.max(v4) - F.min(v4)).alias("rng4"))
    g = g.select(key, "mean", "sd", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "sd4", "rng4")
    return g.withColumns({"max_m_mean": F.col("q100") - F.col("mean"), "mean_m_min": F.col("mean") - F.col("q0"),
                          "q90_m_q10": F.col("q90") - F.col("q10")})


def nonlinear_means(blocks: DataFrame, value: str, rates: dict[str, float], key: str = "id") -> DataFrame:
    return blocks.groupBy(key).agg(*[F.avg(F.exp(r * F.col(value))).alias(n) for n, r in rates.items()])


def weighted_block_stats(blocks: DataFrame, value: str, weight: Column, key: str = "id") -> DataFrame:
    return blocks.groupBy(key).agg(wmean(value, weight).alias("wmean"), F.stddev_pop(value).alias("sd"), F.percentile(value, 0.9).alias("q90"))


def pooled_predictions(units: DataFrame, pred: str, weight: Column, key: str = "id") -> DataFrame:
    """Entity features from unit predictions."""
    return units.groupBy(key).agg(
        F.avg(pred).alias("mil_mean"), wmean(pred, weight).alias("mil_wmean"), F.percentile(pred, 0.1).alias("mil_q10"),
        F.percentile(pred, 0.5).alias("mil_q50"), F.percentile(pred, 0.9).alias("mil_q90"), F.max(pred).alias("mil_max"),
        F.min(pred).alias("mil_min"), F.stddev_pop(pred).alias("mil_sd"))


def group_mean_back(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "img_") -> DataFrame:
    """Group means on every row: a combining aggregate joined back, so a hot group is not one window task."""
    g = df.groupBy(*keys).agg(*[F.avg(c).alias(prefix + c) for c in cols])
    return df.join(g, list(keys))


def context_value(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in cols])


def block_matrix(blocks: DataFrame, value: str, n: int, key: str = "id") -> DataFrame:
    """Fixed-width row of block values b00, b01, ..."""
    wide = blocks.groupBy(key).pivot("blk", list(range(n))).agg(F.first(value))
    return wide.select(key, *[F.col(str(i)).alias(f"b{i:02d}") for i in range(n)])


def cell_vector_stats(vec: DataFrame, channels: int, block: int, key: str = "id") -> DataFrame:
    """Statistics across the cells of each channel, then the mean per channel block."""
    ch = (F.col("dim") % channels).cast("int")
    per = vec.groupBy(key, ch.alias("ch")).agg(
        F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("range"), F.max("v").alias("max"), F.min("v").alias("min"))
    return per.groupBy(key, F.floor(F.col("ch") / block).cast("int").alias("cblk")).agg(
        *[F.avg(c).alias(c) for c in ("std", "range", "max", "min")])


def view_average(vec: DataFrame, channels: int, key: str = "id") -> DataFrame:
    return vec.groupBy(key, (F.col("dim") % channels).cast("int").alias("ch")).agg(F.avg("v").alias("v"))


def ring_stats(px: DataFrame, size: int, key: str = "img") -> DataFrame:
    """Mean of the outer ring, mean of the inside, sd over all cells."""
    e = size - 1
    ring = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == e) | (F.col("x") == e)
    return px.groupBy(key).agg(F.avg(F.when(ring, F.col("v"))).alias("c_ring0"), F.avg(F.when(~ring, F.col("v"))).alias("c_inner"),
                               F.stddev_pop("v").alias("c_sd"))


def window_dispersion(mask: DataFrame, units: DataFrame, size: int, cells: int) -> DataFrame:
    """Variance of the window fraction against the binomial expectation from the unit counts.

    ``mask`` (img, y, x, m) and ``units`` (img, cy, cx). Windows without a unit count as one.
    """
    step = size // cells
    fr = mask.groupBy("img", grid_index(size, cells).alias("w")).agg(F.avg(F.col("m").cast("double")).alias("fr"), F.count(F.lit(1)).alias("px"))
    wi = (F.floor(F.col("cy") / step) * cells + F.floor(F.col("cx") / step)).cast("int")
    cnt = units.groupBy("img", wi.alias("w")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    j = fr.join(cnt, ["img", "w"], "left").fillna(0.0, ["c"])
    g = j.groupBy("img").agg(F.var_pop("fr").alias("v"), F.avg("fr").alias("p"), F.avg(1 / F.greatest("c", F.lit(1.0))).alias("inv"),
                             F.stddev_pop("c").alias("cs"), F.avg("c").alias("cm"))
    exp = F.col("p") * (1 - F.col("p")) * F.col("inv")
    return g.select("img", (F.col("v") / F.greatest(exp, F.lit(1e-6))).alias("disp"), F.sqrt("v").alias("cell_sd"),
                    (F.col("cs") / F.greatest(F.col("cm"), F.lit(1e-6))).alias("count_cv"))


def block_fraction_sd(mask: DataFrame, size: int, cells: int) -> DataFrame:
    fr = mask.groupBy("img", grid_index(size, cells).alias("w")).agg(F.avg(F.col("m").cast("double")).alias("fr"))
    return fr.groupBy("img").agg(F.stddev_pop("fr").alias("fd_blk_sd"))
