"""Two-component mixtures and robust surfaces per entity, on bounded summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mix import draws
from ..functions.scalar import by_value
from ..session import cut_lineage, written
from .metrics import kde
from .raster import histograms


def _em(x: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    """Weights, means, sds of two Gaussians for every row of a (rows x bins) histogram."""
    n = h.sum(1, keepdims=True)
    p = h / np.maximum(n, 1)
    c = np.cumsum(p, 1)
    mu = np.stack([x[(c >= 0.15).argmax(1)], x[(c >= 0.7).argmax(1)]], 1)
    m = (p * x).sum(1, keepdims=True)
    sd = np.sqrt(np.maximum((p * (x - m) ** 2).sum(1, keepdims=True), 1e-6)).repeat(2, 1)
    w = np.full_like(mu, 0.5)
    for _ in range(rounds):
        d = w[:, :, None] / sd[:, :, None] * np.exp(-0.5 * ((x - mu[:, :, None]) / sd[:, :, None]) ** 2) + 1e-300
        r = d / d.sum(1, keepdims=True) * p[:, None, :]
        k = np.maximum(r.sum(2), 1e-12)
        w, mu = k / k.sum(1, keepdims=True), (r * x).sum(2) / k
        sd = np.sqrt(np.maximum((r * (x - mu[:, :, None]) ** 2).sum(2) / k, 1e-6))
    return np.concatenate([w, mu, sd], 1)


def entity_mixture(df: DataFrame, bin_: Column, lo: float, width: float, n: int, gap: float, fallback: float, rounds: int = 60) -> DataFrame:
    """Two-component mixture per image from its histogram: weights, means, sds, separation and crossing threshold.

    The histogram is built by a combining aggregate; a task sees only the fixed number of bins of each image.
    """
    x = lo + width * (np.arange(n) + 0.5)

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            e = _em(x, np.stack(b["h"].to_numpy()).astype(float), rounds)
            low = e[:, 2:4].argmin(1)
            i = np.arange(len(e))
            w, m0, m1, s0, s1 = e[i, low], e[i, 2 + low], e[i, 3 - low], e[i, 4 + low], e[i, 5 - low]
            t = np.linspace(0, 1, 200)
            xs = m0[:, None] + t * (m1 - m0)[:, None]
            d0 = w[:, None] / s0[:, None] * np.exp(-0.5 * ((xs - m0[:, None]) / s0[:, None]) ** 2)
            d1 = (1 - w)[:, None] / s1[:, None] * np.exp(-0.5 * ((xs - m1[:, None]) / s1[:, None]) ** 2)
            cross = xs[i, np.abs(d0 / np.maximum(d0 + d1, 1e-300) - 0.5).argmin(1)]
            yield pd.DataFrame({"img": b["img"], "w_lo": w, "mu_lo": m0, "mu_hi": m1, "sd_lo": s0, "sd_hi": s1, "sep": (m1 - m0) / (s0 + s1),
                                "thr": np.where(m1 - m0 > gap, cross, fallback)})

    schema = "img bigint, w_lo double, mu_lo double, mu_hi double, sd_lo double, sd_hi double, sep double, thr double"
    return histograms(df, bin_, n).mapInPandas(run, schema)


def mixture_share(df: DataFrame, z: str, positive: DataFrame, negative: DataFrame, lo: float, hi: float, bandwidth: float, reps: int = 500,
                  cells: int = 200, key: str = "id", rounds: int = 300, seed: int = 0) -> dict:
    """Share of the positive class among the rows, given samples of both classes; with a bootstrap interval.

    Densities are kernel estimates on a fixed grid and the rows enter as counts per grid cell, so each
    EM step is a weighted mean over the cells. Counts of all bootstrap replicates come from one aggregate.
    """
    step = (hi - lo) / (cells - 1)
    grid = [lo + step * i for i in range(cells)]
    dens = [np.array([r["dens"] for r in kde(d, [], z, grid, bandwidth).orderBy("i").collect()]) for d in (positive, negative)]
    cell = F.least(F.greatest(F.round((F.col(z) - lo) / step), F.lit(0)), F.lit(cells - 1)).cast("int")
    long = draws(df.select(key, cell.alias("c")), key, range(reps + 1), "_w", seed=seed, poisson=True)
    w = F.when(F.col("rep") == 0, 1.0).otherwise(F.col("_w"))
    counts = np.zeros((reps + 1, cells))
    for r in long.groupBy("rep", "c").agg(F.sum(w).alias("n")).collect():
        counts[r["rep"], r["c"]] = r["n"]
    f1, f0 = dens[0] + 1e-12, dens[1] + 1e-12
    pi = np.full(reps + 1, 0.5)
    for _ in range(rounds):
        r = pi[:, None] * f1 / (pi[:, None] * f1 + (1 - pi[:, None]) * f0)
        pi = (counts * r).sum(1) / counts.sum(1)
    lo_, mid, hi_ = np.quantile(pi[1:], [0.05, 0.5, 0.95])
    return {"share": float(pi[0]), "q05": float(lo_), "q50": float(mid), "q95": float(hi_)}


# ---------------------------------------------------------------- robust shading surface
def _surface_terms(size: float) -> list[Column]:
    x, y = F.col("cx") / size - 0.5, F.col("cy") / size - 0.5
    return [F.lit(1.0), x, y, x * x, y * y, x * y]


def _fit_surface(df: DataFrame, keep: Column, value: str, weight: str, size: float) -> DataFrame:
    """Weighted quadratic surface of each entity: sums in Spark, the 6 x 6 solves vectorised over entities."""
    t = _surface_terms(size)
    w = F.when(keep, F.col(weight)).otherwise(0.0)
    aggs = [F.sum(w * t[i] * t[j]) for i in range(6) for j in range(i, 6)] + [F.sum(w * a * F.col(value)) for a in t]
    g = df.groupBy("img").agg(F.array(*aggs).alias("g"))
    iu = np.triu_indices(6)

    def run(batches):
        for b in batches:
            if b.empty:
                continue
            s = np.stack(b["g"].to_numpy()).astype(float)
            a = np.zeros((len(s), 6, 6))
            a[:, iu[0], iu[1]] = s[:, :21]
            a[:, iu[1], iu[0]] = s[:, :21]
            beta = (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ s[:, 21:, None])[:, :, 0]
            yield pd.DataFrame({"img": b["img"], "beta": list(beta)})

    return g.mapInPandas(run, "img bigint, beta array<double>")


def _ratio(df: DataFrame, beta: DataFrame, value: str, size: float, keep_fit: bool = False) -> DataFrame:
    beta = beta.select("*", *[F.col("beta")[i].alias(f"_b{i}") for i in range(6)]).drop("beta")
    fit = sum((F.col(f"_b{i}") * t for i, t in enumerate(_surface_terms(size))), F.lit(0.0))
    d = df.join(beta, "img").withColumn("_f", fit)
    d = d.withColumn("ratio", F.when(F.abs("_f") > 1e-12, F.col(value) / F.col("_f"))).drop("_f")
    return d if keep_fit else d.drop(*[f"_b{i}" for i in range(6)])


def shading_ratio(df: DataFrame, value: str = "grey", weight: str = "area", size: float = 256.0, floor: float = 0.93, rounds: int = 4, big: float = 30.0) -> DataFrame:
    """Value over a robust quadratic surface fitted to the bright units; four re-selection rounds."""
    from ..functions.ranks import quantiles

    med = quantiles(df.where(F.col(weight) > big), ["img"], value, {"_m": 0.5}).drop("n_total")
    d = cut_lineage(df.join(med, "img", "left").withColumn("keep", F.coalesce(F.col(value) > 0.9 * F.col("_m"), F.lit(True))).drop("_m"))
    for _ in range(rounds):
        d = cut_lineage(_ratio(d.drop("ratio"), _fit_surface(d, F.col("keep"), value, weight, size), value, size).withColumn(
            "keep", F.coalesce(F.col("ratio") > floor, F.lit(False))))
    return d


def _valley(ratio: str, weight: str, lo: float, hi: float, cells: int, window: tuple[float, float]) -> tuple[list[Column], Column]:
    """Aggregates of one entity's rows, and the threshold from them.

    A cell of the smoothed histogram is a weighted sum over the cells up to two away, so the few cells of the window are sums over rows.
    """
    step = (hi - lo) / cells
    b = F.least(F.greatest(F.floor((F.col(ratio) - lo) / step), F.lit(0)), F.lit(cells - 1)).cast("int")
    near = range(int((window[0] - lo) / step), int((window[1] - lo) / step) + 1)
    sums = [F.sum(F.col(weight) * F.greatest(F.lit(3) - F.abs(b - i), F.lit(0))).alias(f"_s{i}") for i in near]
    best = F.least(*[F.struct(F.col(f"_s{i}").alias("v"), F.lit(i).alias("i")) for i in near])
    return sums, lo + step * (best["i"] + 0.5)


def valley_threshold(df: DataFrame, ratio: str, weight: str, lo: float, hi: float, cells: int, window: tuple[float, float]) -> DataFrame:
    """Lowest point of the smoothed weighted histogram of each entity inside a window."""
    sums, thr = _valley(ratio, weight, lo, hi, cells, window)
    return df.where(F.col(ratio).isNotNull()).groupBy("img").agg(*sums).select("img", thr.alias("thr"))


def surface_and_phase(df: DataFrame, value: str = "grey", weight: str = "area", size: float = 256.0, rounds: int = 4,
                      window: tuple[float, float] = (0.8, 0.98)) -> DataFrame:
    """Alternates a surface fitted to the bright phase with the valley threshold between the phases.

    Only the surface and the threshold of each entity pass from round to round, as a small table written every round; the rows
    stay as they are and meet them again.
    """
    sums, thr = _valley("ratio", weight, 0.4, 1.6, 48, window)
    found = None
    phase = lambda f: _ratio(df, f, value, size).withColumn("keep", F.coalesce(F.col("ratio") > F.col("thr"), F.lit(False)))
    for _ in range(rounds):
        d = df.withColumn("keep", F.lit(True)) if found is None else phase(found)
        r = _ratio(df, _fit_surface(d, F.col("keep"), value, weight, size), value, size, keep_fit=True)
        surface = [F.first(f"_b{i}").alias(f"_b{i}") for i in range(6)]
        g = r.where("ratio is not null").groupBy("img").agg(*surface, *sums)
        found = written(g.select("img", F.array(*[F.col(f"_b{i}") for i in range(6)]).alias("beta"), thr.alias("thr")), "phase")
    return phase(found)


def pass_share(df: DataFrame, score: str, cut: float, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg((F.col(score) >= cut).cast("double")).alias("pass_share"), F.count(F.lit(1)).alias("n"))


def label_prior(table: dict, key: str) -> Column:
    return by_value(key, table)
