"""Linear fits from fold Grams: offsets, stretches, ridge paths, probes, partial statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..functions.scalar import add_all, by_value, col, linear
from .gram import crossfit_ols, design_exprs, gram, leave_out, predict_by_fold, solve, total
from .metrics import safe_corr, safe_div


def residualise(df: DataFrame, a: str, b: str, out: str, fold: str = "fold", fit: Column | None = None) -> DataFrame:
    """a minus its leave-fold-out line on b."""
    d = crossfit_ols(df, a, [b], "_p", fold, fit, outside=None)
    return d.withColumn(out, F.col(a) - F.col("_p")).drop("_p")


def readers_offset(df: DataFrame, readers: dict[str, str], resid: str, gate: Column, out: str = "offset", fold: str = "fold") -> DataFrame:
    """Offset on the gated rows: readers residualised on their size column, then a fit without intercept to the
    centred residual. Everything follows from one Gram per fold over [1, readers, sizes, residual].
    """
    names, sizes = list(readers), list(dict.fromkeys(readers.values()))
    cols = [F.lit(1.0), *[F.col(c) for c in names], *[F.col(c) for c in sizes], F.col(resid)]
    gs = gram(df.where(gate), cols, [fold])
    k = len(names)
    parts = {}
    for key, g in leave_out(gs).items():
        t = np.zeros((len(g), k))  # residualised readers as combinations of the raw columns
        for i, n in enumerate(names):
            s = 1 + k + sizes.index(readers[n])
            a = np.linalg.solve(g[np.ix_([0, s], [0, s])], g[[0, s], 1 + i])
            t[1 + i, i], t[0, i], t[s, i] = 1.0, -a[0], -a[1]
        r = np.zeros(len(g))
        r[-1], r[0] = 1.0, -g[0, -1] / g[0, 0]
        beta = np.linalg.lstsq(t.T @ g @ t, t.T @ g @ r, rcond=None)[0]
        w = t @ beta
        parts[key[0]] = linear(w[1:-1], [*names, *sizes], w[0])
    return df.withColumn(out, F.when(gate, by_value(fold, parts)).otherwise(0.0))


def slope_stretch(df: DataFrame, pred: str, y: str, q: str, gate: Column, share: float, rho: float, out: str = "stretched", fold: str = "fold") -> DataFrame:
    """Stretch gated predictions below the leave-fold-out median of ``q``: c + k (p - c), k = 1 + share (b / rho - 1)."""
    from .columns import leave_out_medians
    from .folds import fold_ids

    rows = df.where(gate)
    folds = fold_ids(df, fold)
    med = leave_out_medians(rows, [q], fold, folds)[q]
    # rows below the median of outer fold k, per own fold: one pass over all (outer, own) pairs
    outer = F.array(*[F.struct(F.lit(k).alias("outer"), (F.col(q) < med[k]).alias("lo")) for k in folds])
    low = rows.select(fold, pred, y, F.inline(outer)).where((F.col("outer") != F.col(fold)) & F.col("lo"))
    fit = {r["outer"]: r for r in low.groupBy("outer").agg(F.avg(pred).alias("c"), F.regr_slope(y, pred).alias("b")).collect()}
    new = {k: F.when(F.col(q) < med[k], fit[k]["c"] + (1 + share * (fit[k]["b"] / rho - 1)) * (F.col(pred) - fit[k]["c"])) for k in folds}
    return df.withColumn(out, F.coalesce(F.when(gate, by_value(fold, new)), F.col(pred)))


def robust_slopes(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope per group with its HC1 standard error (two aggregates, the second over squared residuals)."""
    m = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.var_pop(x).alias("vx"), F.regr_slope(y, x).alias("b"),
                            F.regr_intercept(y, x).alias("a"))
    d = df.join(m, list(by))
    e = F.col(y) - F.col("a") - F.col("b") * F.col(x)
    s = d.groupBy(*by, "n", "vx", "b").agg(F.sum(F.pow((F.col(x) - F.col("mx")) * e, 2)).alias("meat"))
    n = F.col("n").cast("double")
    return s.select(*by, "n", F.col("b").alias("slope"), (F.sqrt(F.col("meat") * n / (n - 2)) / (n * F.col("vx"))).alias("se"))


def shrunk_slopes(slopes: DataFrame, centre: float = 1.0) -> DataFrame:
    """Empirical-Bayes shrink of group slopes toward ``centre``."""
    tau2 = slopes.agg(F.avg(F.greatest(F.pow(F.col("slope") - centre, 2) - F.col("se") * F.col("se"), F.lit(0.0))).alias("t")).first()["t"]
    w = tau2 / (F.lit(tau2) + F.col("se") * F.col("se"))
    return slopes.select("*", w.alias("w"), (centre + w * (F.col("slope") - centre)).alias("shrunk"))


def log_smearing(df: DataFrame, x: str, y: str, out: str = "pred", fold: str = "fold") -> DataFrame:
    """Leave-fold-out line for log y with the variance correction exp(f + s^2 / 2)."""
    coefs = {}
    for k, g in leave_out(gram(df, design_exprs([x], F.log(y)), [fold])).items():
        w = solve(g)
        sse = g[-1, -1] - w @ g[:-1, -1]
        s2 = sse / g[0, 0]
        coefs[k[0]] = F.exp(linear(w[1:], [x], w[0] + s2 / 2))
    return df.withColumn(out, by_value(fold, coefs))


# ---------------------------------------------------------------- standardised ridge from Grams
def centred_parts(g: np.ndarray, ddof: int = 0):
    """(n, means, sds, standardised X'X, standardised X'y, mean y, y'y centred) of a [1, X, y] Gram."""
    n = g[0, 0]
    mu = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0) / (n - ddof))
    sd[sd < 1e-12] = 1.0
    return n, mu[:-1], sd, c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, mu[-1], c[-1, -1]


def ridge_coefs(g: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """Raw-scale [intercept, coefs] for every penalty from one eigen decomposition."""
    n, mu, sd, a, b, my, _ = centred_parts(g)
    lam, q = np.linalg.eigh(a)
    lam, u = np.maximum(lam, 0), q.T @ b
    out = []
    for al in alphas:
        w = (q @ (u / (lam + al))) / sd
        out.append(np.r_[my - w @ mu, w])
    return out


def gram_sse(g: np.ndarray, w: np.ndarray) -> float:
    """Squared error of coefficients on the rows behind a Gram."""
    v = np.r_[-w, 1.0]
    return float(v @ g @ v)


def ridge_nested(grams: dict, alphas: Sequence[float]) -> dict:
    """Per outer fold: penalty chosen by leave-one-fold-out inside, and the refitted coefficients. Driver only."""
    t = total(grams)
    out = {}
    for k in grams:
        sse = np.zeros(len(alphas))
        for j in grams:
            if j != k:
                for i, w in enumerate(ridge_coefs(t - grams[k] - grams[j], alphas)):
                    sse[i] += gram_sse(grams[j], w)
        best = int(np.argmin(sse))
        out[k] = (alphas[best], ridge_coefs(t - grams[k], [alphas[best]])[0], float(np.sqrt(sse[best] / (t - grams[k])[0, 0])))
    return out


def crossfit_ridge(df: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float], out: str = "pred", fold: str = "fold", weight=None) -> tuple[DataFrame, dict]:
    fits = ridge_nested(gram(df, design_exprs(xs, y), [fold], weight), alphas)
    pred = predict_by_fold({k: v[1] for k, v in fits.items()}, xs, fold)
    return df.withColumn(out, pred), {k[0]: v[0] for k, v in fits.items()}


def nested_predictions(df: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float], out: str = "pred", fold: str = "fold") -> DataFrame:
    """Inner and outer out-of-fold predictions for stacking: every row once per outer fold (column ``outer``).

    A row of fold j gets, under outer fold k, the model fitted without k and without j (j = k: the outer model). All pairs of folds
    come from one pass: their Grams are the total less one or two folds. The penalty is chosen inside the fitted folds.
    """
    gs = gram(df, design_exprs(xs, y), [fold])
    coefs = {}
    for k in gs:
        rest = {j: g for j, g in gs.items() if j != k}
        for j in gs:
            own = {i: g for i, g in rest.items() if i != j}
            sse = np.zeros(len(alphas))
            for i, g in own.items():
                for at, w in enumerate(ridge_coefs(total(own) - g, alphas)):
                    sse[at] += gram_sse(g, w)
            coefs[k, j] = ridge_coefs(total(own), [alphas[int(sse.argmin())]])[0]
    long = F.array(*[F.struct(F.lit(k[0]).alias("outer"), predict_by_fold({j: coefs[k, j] for j in gs}, xs, fold).alias(out)) for k in sorted(gs)])
    return df.select("*", F.inline(long))


def ridge_loo(df: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float], out: str = "pred", fold: str = "fold") -> tuple[DataFrame, dict]:
    """Ridge whose penalty minimises the leave-one-out error of the training rows.

    Hat values are local to a row in the eigenbasis, so one more pass over the rows scores every
    penalty for every outer fold.
    """
    t = leave_out(gram(df, design_exprs(xs, y), [fold]))
    per_fold, stats = [], {}
    for k, g in t.items():
        n, mu, sd, a, b, my, _ = centred_parts(g)
        lam, q = np.linalg.eigh(a)
        stats[k[0]] = (n, np.maximum(lam, 0), q.T @ b)
        rot = q / sd[:, None]
        per_fold.append(F.struct(F.lit(k[0]).alias("outer"), (F.col(y) - float(my)).alias("yc"),
                                 *[linear(rot[:, i], xs, -float(mu @ rot[:, i])).alias(f"u{i}") for i in range(len(xs))]))
    long = df.select(fold, F.inline(F.array(*per_fold))).where(F.col("outer") != F.col(fold))
    nk = by_value("outer", {k: float(s[0]) for k, s in stats.items()}, 1.0)
    aggs = []
    for j, al in enumerate(alphas):
        hat, fit = [], []
        for i in range(len(xs)):
            inv = by_value("outer", {k: float(1 / (s[1][i] + al)) for k, s in stats.items()}, 0.0)
            c = by_value("outer", {k: float(s[2][i] / (s[1][i] + al)) for k, s in stats.items()}, 0.0)
            hat.append(F.col(f"u{i}") * F.col(f"u{i}") * inv)
            fit.append(F.col(f"u{i}") * c)
        e = (F.col("yc") - add_all(fit)) / (1 - 1 / nk - add_all(hat))
        aggs.append(F.sum(e * e).alias(f"e{j}"))
    best = {r["outer"]: alphas[int(np.argmin([r[f"e{j}"] for j in range(len(alphas))]))] for r in long.groupBy("outer").agg(*aggs).collect()}
    coefs = {k: ridge_coefs(g, [best[k[0]]])[0] for k, g in t.items()}
    return df.withColumn(out, predict_by_fold(coefs, xs, fold)), best


def generalised_ridge(between: DataFrame, deviations: dict[str, DataFrame], y: str, xs: Sequence[str], lams: Sequence[float],
                      alphas: Sequence[float], out: str = "pred", fold: str = "fold") -> tuple[DataFrame, dict]:
    """Ridge with one more penalty per nuisance type: |w . deviation|^2 averaged over the deviation rows.

    Only the extra deviation Grams are needed; all penalty combinations are then solved on the driver
    and scored on the inner folds through the Grams.
    """
    import itertools

    gs = gram(between, design_exprs(xs, y), [fold])
    ds = {n: gram(d, [*xs, F.lit(1.0)], [fold]) for n, d in deviations.items()}
    grid = [(*ls, a) for ls in itertools.product(*[lams] * len(ds)) for a in alphas]

    def fit(keys, point):
        g = sum(gs[k] for k in keys)
        n, mu, sd, a, b, my, _ = centred_parts(g)
        m = a + point[-1] * np.eye(len(a))
        for lam, name in zip(point, ds):
            d = sum(ds[name][k] for k in keys)
            m = m + lam * d[:-1, :-1] / np.outer(sd, sd) / (d[-1, -1] / n)
        w = np.linalg.solve(m, b) / sd
        return np.r_[my - w @ mu, w]

    coefs, picks = {}, {}
    for k in gs:
        others = [j for j in gs if j != k]
        sse = [sum(gram_sse(gs[j], fit([i for i in others if i != j], p)) for j in others) for p in grid]
        picks[k[0]] = grid[int(np.argmin(sse))]
        coefs[k] = fit(others, picks[k[0]])
    return between.withColumn(out, predict_by_fold(coefs, xs, fold)), picks


class _Split:
    """A ridge fit on one training Gram that grows column by column, with the Gram of its held-out rows in training units."""

    def __init__(self, train: np.ndarray, held: np.ndarray, alpha: float):
        _, mu, sd, self.a, self.b, my, _ = centred_parts(train)
        to = np.eye(len(train))  # [1, x, y] -> [1, (x - mean) / sd, y - mean]
        to[1:-1, 0], to[-1, 0] = -mu, -my
        to[1:-1] /= sd[:, None]
        self.held = (to @ held @ to.T)[1:, 1:]
        self.alpha, self.inverse = alpha, np.zeros((0, 0))

    def errors(self, chosen: list[int], rest: list[int]) -> np.ndarray:
        """Held-out squared error for each further column, all at once by the bordered inverse."""
        cross = self.a[np.ix_(chosen, rest)]
        lift = self.inverse @ cross
        gap = self.a[rest, rest] + self.alpha - (cross * lift).sum(axis=0)
        new = (self.b[rest] - lift.T @ self.b[chosen]) / gap
        old = (self.inverse @ self.b[chosen])[:, None] - lift * new
        h = self.held
        fit = 2 * (h[chosen, -1] @ old + h[rest, -1] * new)
        spread = (old * (h[np.ix_(chosen, chosen)] @ old)).sum(axis=0) + 2 * new * (h[np.ix_(chosen, rest)] * old).sum(axis=0) + new * new * h[rest, rest]
        return h[-1, -1] - fit + spread

    def grow(self, chosen: list[int], j: int) -> None:
        idx = [*chosen, j]
        self.inverse = np.linalg.inv(self.a[np.ix_(idx, idx)] + self.alpha * np.eye(len(idx)))


def infold_columns(grams: dict, names: Sequence[str], alpha: float, most: int, gain: float) -> dict:
    """{outer fold: columns} chosen without that fold: at each step the column with the smallest leave-one-fold-out error of
    the other folds enters, while the root mean squared error falls by at least ``gain``."""
    picks = {}
    for outer in grams:
        others = {k: g for k, g in grams.items() if k != outer}
        whole = total(others)
        splits = [_Split(whole - g, g, alpha) for g in others.values()]
        chosen, rest, best = [], list(range(len(names))), np.inf
        while rest and len(chosen) < most:
            rmse = np.sqrt(np.maximum(sum(s.errors(chosen, rest) for s in splits), 0) / whole[0, 0])
            at = int(rmse.argmin())
            if rmse[at] > best - gain:
                break
            best = float(rmse[at])
            for s in splits:
                s.grow(chosen, rest[at])
            chosen.append(rest.pop(at))
        picks[outer] = [names[j] for j in chosen]
    return picks


def crossfit_selected(df: DataFrame, grams: dict, names: Sequence[str], picks: dict, alpha: float, out: str = "pred", fold: str = "fold") -> DataFrame:
    """Out-of-fold ridge in which every fold uses its own columns; ``columns`` names them."""
    t, coefs = total(grams), {}
    for k, cols in picks.items():
        pos = [0, *[1 + list(names).index(c) for c in cols], len(names) + 1]
        coefs[k] = np.zeros(len(names) + 1)
        coefs[k][pos[:-1]] = ridge_coefs((t - grams[k])[np.ix_(pos, pos)], [alpha])[0]
    label = by_value(fold, {k[0]: F.lit(",".join(c)) for k, c in picks.items()})
    return df.withColumn(out, predict_by_fold(coefs, names, fold)).withColumn("columns", label)


def principal_components(df: DataFrame, cols: Sequence[str], k: int, train: Column | None = None, whiten: bool = False, prefix: str = "pc") -> DataFrame:
    """PCA from the training Gram; each axis is signed so that its largest loading is positive."""
    g = total(gram(df if train is None else df.where(train), [F.lit(1.0), *cols]))
    n, mu = g[0, 0], g[0, 1:] / g[0, 0]
    lam, q = np.linalg.eigh(g[1:, 1:] / n - np.outer(mu, mu))
    lam, q = lam[::-1][:k], q[:, ::-1][:, :k]
    q = q * np.sign(q[np.abs(q).argmax(0), range(q.shape[1])])
    if whiten:
        q = q / np.sqrt(np.maximum(lam, 1e-12))
    return df.select("*", *[linear(q[:, i], cols, -float(mu @ q[:, i])).alias(f"{prefix}{i}") for i in range(k)])


def probe_coefs(gs: dict, fs: dict, nb: int, ne: int, alphas: Sequence[float]) -> tuple[dict, dict]:
    """Base and probe coefficients per outer fold from Grams [1, base, extra, y]; ``fs`` holds the rows the probe is fitted on."""
    t = total(gs)
    bi, ei = [0, *range(1, nb + 1), nb + ne + 1], [0, *range(nb + 1, nb + ne + 1)]
    base_w, probe_w = {}, {}
    for k in gs:
        outer = t - gs[k]
        nested = ridge_nested({j: g[np.ix_(bi, bi)] for j, g in gs.items() if j != k}, alphas)
        alpha = float(np.median([v[0] for v in nested.values()]))
        pg = {}
        for j in gs:
            if j == k:
                continue
            w = ridge_coefs((outer - gs[j])[np.ix_(bi, bi)], [alpha])[0]
            lift = np.zeros((nb + ne + 2, ne + 2))
            for c, i in enumerate(ei):
                lift[i, c] = 1.0
            lift[-1, -1] = 1.0
            lift[bi[:-1], -1] -= w
            pg[j] = lift.T @ fs.get(j, np.zeros_like(outer)) @ lift
        best = ridge_nested(pg, alphas)
        pa = float(np.median([v[0] for v in best.values()]))
        probe_w[k] = ridge_coefs(total(pg), [pa])[0]
        base_w[k] = ridge_coefs(outer[np.ix_(bi, bi)], [alpha])[0]
    return base_w, probe_w


def residual_probe(df: DataFrame, y: str, base: Sequence[str], extra: Sequence[str], alphas: Sequence[float], fold: str = "fold",
                   fit: Column | None = None, apply: Column | None = None) -> DataFrame:
    """Leak-free probe: base and probe out of fold, the probe trained on inner cross-fitted base residuals.

    The residual of fold j under outer fold k uses the base fitted without both; its cross products
    with the probe columns are linear in the joint fold Gram, so a single pass over the rows is enough.
    """
    cols = [F.lit(1.0), *[F.col(c) for c in base], *[F.col(c) for c in extra], F.col(y)]
    gs = gram(df, cols, [fold])
    fs = gs if fit is None else gram(df.where(fit), cols, [fold])
    base_w, probe_w = probe_coefs(gs, fs, len(base), len(extra), alphas)
    out = df.withColumn("base_pred", predict_by_fold(base_w, base, fold))
    p = predict_by_fold(probe_w, extra, fold)
    return out.withColumn("probe", p if apply is None else F.when(apply, p).otherwise(0.0))


# ---------------------------------------------------------------- closed-form statistics
def partial_stats(df: DataFrame, x: str, y: str, z: str, by: Sequence[str] = ()) -> DataFrame:
    """Partial correlation, slope of y on x and sd ratio, all given z."""
    v = {c: F.var_pop(c) for c in (x, y, z)}
    xy, xz, yz = F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z)
    vx, vy, cxy = v[x] - xz * xz / v[z], v[y] - yz * yz / v[z], xy - xz * yz / v[z]
    return df.groupBy(*by).agg((cxy / F.sqrt(vx * vy)).alias("pcorr"), (cxy / vx).alias("pslope"), F.sqrt(vy / vx).alias("sd_ratio"))


def mahalanobis(df: DataFrame, a: str, b: str, cloud: Column) -> DataFrame:
    """Distance of every row to the mean of a reference cloud (sample covariance)."""
    m = df.where(cloud).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c")).first()
    inv = np.linalg.inv(np.array([[m["va"], m["c"]], [m["c"], m["vb"]]]))
    da, db = F.col(a) - m["ma"], F.col(b) - m["mb"]
    return df.withColumn("dist", F.sqrt(da * da * float(inv[0, 0]) + 2 * da * db * float(inv[0, 1]) + db * db * float(inv[1, 1])))


def reader_metrics(blocks: DataFrame, pred: str, target: str, size: str, key: str = "id") -> DataFrame:
    """How well predicted blocks follow the targets: overall, inside entities, and their spread per entity."""
    g = blocks.groupBy(key).agg(F.avg(pred).alias("_mp"), F.avg(target).alias("_mt"), F.stddev_pop(pred).alias("hp"), F.stddev_pop(target).alias("ht"), F.max(size).alias("s"))
    w = blocks.join(g.select(key, "_mp", "_mt"), key)
    b = w.agg(safe_corr(pred, target).alias("corr_block"), safe_corr(F.col(pred) - F.col("_mp"), F.col(target) - F.col("_mt")).alias("corr_block_within"))
    h = g.agg(safe_corr("hp", "ht").alias("corr_het"), F.avg("hp").alias("het_hat_mean"), F.avg("ht").alias("het_mean"))
    p = partial_stats(g, "hp", "ht", "s").select(F.col("pcorr").alias("pcorr_het"), F.col("pslope").alias("slope_het"), F.col("sd_ratio").alias("sdratio_het"))
    one = lambda d: d.withColumn("_k", F.lit(1))  # noqa: E731  each side is a single row
    return one(b).join(one(h), "_k").join(one(p), "_k").drop("_k")


def attenuation_slopes(df: DataFrame, x: str, y: str, controls: Sequence[str], bin_: str, reps: int, key: str = "id", seed: int = 0) -> DataFrame:
    """Slope of y on x given controls per bin, with a bootstrap interval of each slope's ratio to the last bin's.

    Replicate 0 is the data itself; the others weigh rows by hash Poisson counts. All replicates and
    bins are groups of one Gram.
    """
    from ..functions.mix import draws

    long = draws(df.select(key, x, y, *controls, bin_), key, range(reps + 1), "_w", seed=seed, poisson=True)
    w = F.when(F.col("rep") == 0, 1.0).otherwise(F.col("_w"))
    gs = gram(long, design_exprs([x, *controls], y), ["rep", bin_], w)
    slope = {k: float(solve(g)[1]) for k, g in gs.items()}
    bins = sorted({k[1] for k in slope})
    rows = []
    for b in bins:
        ratio = [slope[(r, b)] / slope[(r, bins[-1])] for r in range(1, reps + 1)]
        rows.append((b, slope[(0, b)], slope[(0, b)] / slope[(0, bins[-1])], float(np.quantile(ratio, 0.05)), float(np.quantile(ratio, 0.95))))
    return df.sparkSession.createDataFrame(rows, "bin int, slope double, ratio double, lo double, hi double")
