"""Non-negative blends of out-of-fold members, solved on member Grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_all, by_value, digitize, linear, ramp
from .columns import leave_out_quantiles
from .folds import fold_ids
from .gram import gram, leave_out, outer_rows, solve, total
from .linear import gram_sse


def nnls_gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares from normal equations (active set)."""
    k = len(b)
    x, free = np.zeros(k), np.zeros(k, bool)
    for _ in range(10 * k + 10):
        grad = b - a @ x
        cand = np.where(~free & (grad > 1e-10 * max(1.0, np.abs(b).max())))[0]
        if not len(cand):
            return x
        free[cand[np.argmax(grad[cand])]] = True
        while True:
            idx = np.where(free)[0]
            z = np.zeros(k)
            z[idx] = np.linalg.lstsq(a[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if (z[idx] > 0).all():
                x = z
                break
            bad = idx[z[idx] <= 0]
            step = min(x[i] / (x[i] - z[i]) if x[i] != z[i] else 0.0 for i in bad)
            x = np.maximum(x + step * (z - x), 0)
            free &= x > 1e-14
            if not free.any():
                break
    return x


def simplex_weights(g: np.ndarray) -> np.ndarray:
    """NNLS weights of a [members, y] Gram rescaled to sum 1; equal weights when all are zero."""
    w = nnls_gram(g[:-1, :-1], g[:-1, -1])
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def _members(names: Sequence[str], y: str) -> list[Column]:
    return [F.col(n) for n in names] + [F.col(y)]


def nested_blend(df: DataFrame, names: Sequence[str], y: str, out: str = "blend", fold: str = "fold") -> tuple[DataFrame, dict]:
    """Every fold is blended with the weights of the other folds; also returns the weights per fold and over all rows."""
    gs = gram(df, _members(names, y), [fold])
    ws = {k[0]: simplex_weights(g) for k, g in leave_out(gs).items()}
    ws_all = simplex_weights(total(gs))
    pred = by_value(fold, {k: linear(w, names) for k, w in ws.items()})
    return df.withColumn(out, pred), {**ws, "all": ws_all}


def cell_blend(df: DataFrame, names: Sequence[str], y: str, cell: str, mode: str = "nnls", share: float = 0.2, cell_share: float = 0.8,
               out: str = "blend", fold: str = "fold") -> DataFrame:
    """Blend by cell. ``nnls``: weights per cell; ``share``: global weights over all but the last member, which then gets a
    fixed share per cell; ``fixed``: as nnls outside, and in the cell NNLS over the others with the last at a fixed share."""
    gs = gram(df, _members(names, y), [fold, cell])
    last, rest = names[-1], list(names[:-1])
    k = len(names)
    sub = [*range(k - 1), k]
    preds = {}
    for f in sorted({key[0] for key in gs}):
        fit = {c: sum(g for (kf, kc), g in gs.items() if kf != f and kc == c) for c in (True, False)}
        base = linear(simplex_weights((fit[True] + fit[False])[np.ix_(sub, sub)]), rest)
        inner = linear(simplex_weights(fit[True][np.ix_(sub, sub)]), rest)
        full = {c: linear(simplex_weights(fit[c]), names) for c in (True, False)}
        mix = lambda b, s: b + s * (F.col(last) - b)
        preds[f] = {"nnls": F.when(F.col(cell), full[True]).otherwise(full[False]),
                    "share": F.when(F.col(cell), mix(base, cell_share)).otherwise(mix(base, share)),
                    "fixed": F.when(F.col(cell), mix(inner, cell_share)).otherwise(full[False])}[mode]
    return df.withColumn(out, by_value(fold, preds))


def screen_candidates(df: DataFrame, y: str, members: dict[str, Sequence[str]], candidates: dict[str, dict[str, Sequence[str]]], fold: str = "fold") -> DataFrame:
    """Candidate column sets as blend members: (candidate, member, fold, base, d_member, d_blend, d_refit).

    ``members`` names the column set of each least-squares member, a candidate replaces some of the sets. ``base`` is the fold's
    out-of-fold RMSE of the replaced member, ``d_member`` its change; ``d_blend`` the change of the blend with the weights of the
    original members kept, ``d_refit`` with weights solved anew. One Gram over the union of all columns serves every candidate:
    fits, member products and blends are sub-matrices of it.
    """
    union = list(dict.fromkeys(c for sets in (members, *candidates.values()) for xs in sets.values() for c in xs))
    gs = gram(df, [F.lit(1.0), *union, y], [fold])
    t, k = total(gs), len(union) + 2

    def fitted(xs: Sequence[str]) -> dict:
        """Coefficients over all columns, per held-out fold."""
        pos = [0, *[1 + union.index(x) for x in xs], k - 1]
        out = {}
        for f, g in gs.items():
            out[f] = np.zeros(k)
            out[f][pos[:-1]] = solve((t - g)[np.ix_(pos, pos)])
        return out

    def rmse(w: dict, f) -> float:
        v = w[f].copy()
        v[-1] = -1.0
        return float(np.sqrt(max(v @ gs[f] @ v, 0.0) / gs[f][0, 0]))

    def products(fits: list[dict]) -> np.ndarray:
        """[members, y] Gram of the out-of-fold predictions."""
        m = np.zeros((len(fits) + 1, len(fits) + 1))
        for f, g in gs.items():
            lift = np.column_stack([*[fit[f] for fit in fits], np.eye(k)[-1]])
            m += lift.T @ g @ lift
        return m

    def blended(fits: list[dict], w: np.ndarray) -> dict:
        return {f: sum(a * fit[f] for a, fit in zip(w, fits)) for f in gs}

    own = {n: fitted(xs) for n, xs in members.items()}
    names = list(own)
    kept = simplex_weights(products([own[n] for n in names]))
    whole = blended([own[n] for n in names], kept)
    rows = []
    for label, sets in candidates.items():
        new = {**own, **{n: fitted(xs) for n, xs in sets.items()}}
        fits = [new[n] for n in names]
        same, anew = blended(fits, kept), blended(fits, simplex_weights(products(fits)))
        for n in sets:
            rows += [(label, n, f[0], rmse(own[n], f), rmse(new[n], f) - rmse(own[n], f), rmse(same, f) - rmse(whole, f), rmse(anew, f) - rmse(whole, f)) for f in sorted(gs)]
    kind = dict(df.dtypes)[fold]
    return df.sparkSession.createDataFrame(rows, f"candidate string, member string, fold {kind}, base double, d_member double, d_blend double, d_refit double")


def quadratic_program(h: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """min 1/2 x'Hx - f'x with A x = b and G x >= 0 from a feasible start (active set, a few variables)."""
    active: list[int] = [i for i in range(len(g)) if abs(g[i] @ x) < 1e-10]
    for _ in range(200):
        c = np.vstack([a, *[g[i:i + 1] for i in active]])
        m = len(c)
        kkt = np.block([[h, c.T], [c, np.zeros((m, m))]])
        sol = np.linalg.lstsq(kkt, np.r_[f - h @ x, np.zeros(m)], rcond=None)[0]
        p, lam = sol[:len(x)], -sol[len(x) + len(a):]
        if np.abs(p).max() < 1e-9:
            if not len(lam) or lam.min() >= -1e-9:
                return x
            active.pop(int(np.argmin(lam)))
            continue
        step, hit = 1.0, None
        for i in range(len(g)):
            d = g[i] @ p
            if i not in active and d < -1e-14:
                s = max(0.0, -(g[i] @ x) / d)
                if s < step:
                    step, hit = s, i
        x = x + step * p
        if hit is not None:
            active.append(hit)
    return x


def _states(kind: str, df: DataFrame, covs: Sequence[str], fold: str, folds: Sequence, q: tuple[float, float], at: str) -> list[Column]:
    """Non-negative state shares of a row that add up to one, from the training rows of the fold named in column ``at``.

    ``tercile``: flags of the first covariate's terciles. ``linear``: products of the shares of the low and the high end of
    each covariate, one state per corner.
    """
    cuts = leave_out_quantiles(df, covs, fold, folds, [1 / 3, 2 / 3] if kind == "tercile" else list(q))
    if kind == "tercile":
        which = by_value(at, {f: digitize(covs[0], cuts[covs[0]][f]) for f in folds})
        return [(which == c).cast("double") for c in range(3)]
    states = [F.lit(1.0)]
    for c in covs:
        high = by_value(at, {f: ramp(c, *cuts[c][f]) for f in folds})
        states = [s * end for s in states for end in (1 - high, high)]
    return states


def state_weights(g: np.ndarray, k: int, alpha: float) -> np.ndarray:
    """One simplex vector of k weights per state from the Gram of [state x member, ..., y].

    The states share every row, so the members themselves are the sums over states. ``alpha`` adds, for each state's vector,
    its squared error over all rows, averaged over the states.
    """
    n = (len(g) - 1) // k
    h, b = g[:-1, :-1], g[:-1, -1]
    fold_in = np.tile(np.eye(k), (n, 1))  # members from state columns
    whole, target = fold_in.T @ h @ fold_in, fold_in.T @ b
    start = nnls_gram(whole, target)
    start = start / start.sum() if start.sum() > 0 else np.full(k, 1 / k)
    h = h + alpha / n * np.kron(np.eye(n), whole)
    b = b + alpha / n * np.tile(target, n)
    unit = np.trace(h) / len(h) or 1.0
    one_per_state = np.kron(np.eye(n), np.ones((1, k)))
    w = quadratic_program(h / unit, b / unit, one_per_state, np.ones(n), np.eye(n * k), np.tile(start, n))
    w = np.maximum(w, 0).reshape(n, k)
    return w / w.sum(axis=1, keepdims=True)


def covariate_blend(df: DataFrame, names: Sequence[str], y: str, covs: Sequence[str], kind: str = "linear", alpha: float = 0.0,
                    q: tuple[float, float] = (0.1, 0.9), out: str = "blend", fold: str = "fold") -> DataFrame:
    """Nested blend whose weights depend on covariates: every state has its own simplex vector, a row mixes the vectors by
    its state shares. One Gram serves all outer folds."""
    folds, k = fold_ids(df, fold), len(names)
    long = outer_rows(df, fold, folds)
    inside = _states(kind, df, covs, fold, folds, q, "outer")
    gs = gram(long, [*[s * F.col(n) for s in inside for n in names], F.col(y)], ["outer"])
    fits = {key[0]: state_weights(g, k, alpha) for key, g in gs.items()}
    here = _states(kind, df, covs, fold, folds, q, fold)
    pred = {f: add_all([s * linear(w[c], names) for c, s in enumerate(here)]) for f, w in fits.items()}
    return df.withColumn(out, by_value(fold, pred))


def inverse_variance_weights(df: DataFrame, resid: str, covs: Sequence[str], lo: float = 0.25, hi: float = 4.0, out: str = "w") -> DataFrame:
    """exp(-(a + b z)) from a line of log(r^2 + 1), divided by its mean, clipped, divided by its mean again."""
    from .gram import design_exprs, solve

    g = total(gram(df, design_exprs(covs, F.log(F.pow(F.col(resid), 2) + 1.0))))
    c = solve(g)
    return normalised_weights(df, F.exp(-linear(c[1:], covs, c[0])), lo, hi, out)


def normalised_weights(df: DataFrame, raw: Column, lo: float, hi: float, out: str) -> DataFrame:
    m1 = df.agg(F.avg(raw).alias("m")).first()["m"]
    w = F.least(F.greatest(raw / m1, F.lit(lo)), F.lit(hi))
    m2 = df.agg(F.avg(w).alias("m")).first()["m"]
    return df.withColumn(out, w / m2)


def additive_variance_weights(df: DataFrame, resid: str, covs: Sequence[str], lo: float = 0.25, hi: float = 4.0, out: str = "w") -> DataFrame:
    """Weights from v = b0 + sum b_k / z_k, b >= 0, fitted to squared residuals on mean-scaled columns."""
    inv = [F.lit(1.0), *[1 / F.greatest(F.col(c), F.lit(1e-3)) for c in covs]]
    g = total(gram(df, [*inv, F.pow(F.col(resid), 2)]))
    n = g[0, 0]
    scale = g[0, :-1] / n
    b = nnls_gram(g[:-1, :-1] / np.outer(scale, scale), g[:-1, -1] / scale) / scale
    v = F.greatest(linear(b, inv), F.lit(1e-3 * g[0, -1] / n))
    return normalised_weights(df, 1 / v, lo, hi, out)
