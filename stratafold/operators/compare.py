"""Comparing candidates with a base, choosing honestly, and rule-based verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import add_all, by_value, expected_max_bias
from .metrics import rmse, safe_corr, safe_div
from .ranking import pick_best


def loss_change(new: str, base: str, y: str = "y") -> Column:
    return F.pow(F.col(new) - F.col(y), 2) - F.pow(F.col(base) - F.col(y), 2)


def compare(df: DataFrame, new: str, base: str, y: str = "y", fold: str = "fold", stratum: str = "g") -> DataFrame:
    """One pass over the rows: change of squared error overall, per fold and per stratum (GROUPING SETS)."""
    d = df.select(fold, stratum, loss_change(new, base, y).alias("d"))
    return d.groupingSets([[], [F.col(fold)], [F.col(stratum)]], F.col(fold), F.col(stratum)).agg(
        F.avg("d").alias("dmse"), F.sum("d").alias("dsse"), F.sum((F.col("d") != 0).cast("bigint")).alias("n_changed"))


def summary(df: DataFrame, new: str, base: str, key: str = "id", y: str = "y", fold: str = "fold", drop: int = 3) -> DataFrame:
    """Overall change, folds better, rows better, and the change without the rows that gain most.

    The dropped rows come from a top-n that each partition limits first.
    """
    d = df.select(key, fold, F.round(loss_change(new, base, y), 9).alias("d"))
    a = d.agg(F.avg("d").alias("dmse"), F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"), F.sum((F.col("d") != 0).cast("bigint")).alias("n_changed"),
              F.sum((F.col("d") < 0).cast("bigint")).alias("rows_better"))
    f = d.groupBy(fold).agg(F.sum("d").alias("f")).agg(F.sum((F.col("f") < 0).cast("bigint")).alias("folds_better"))
    t = d.orderBy("d", key).limit(drop).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("t"), F.count(F.lit(1)).alias("k"))
    one = lambda x: x.withColumn("_k", F.lit(1))  # noqa: E731  single rows
    j = one(a).join(one(f), "_k").join(one(t), "_k")
    return j.select("dmse", "n_changed", "rows_better", "folds_better", ((F.col("s") - F.col("t")) / (F.col("n") - F.col("k"))).alias("droptop"))


def option_losses(df: DataFrame, options: Sequence[str], y: str = "y", by: Sequence[str] = ("fold",)) -> DataFrame:
    o = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("option"), F.pow(F.col(n) - F.col(y), 2).alias("sq")) for i, n in enumerate(options)])
    return df.select(*by, F.inline(o)).groupBy(*by, "option", "ord").agg(F.sum("sq").alias("sse"), F.count(F.lit(1)).alias("n"))


def nested_choice(df: DataFrame, options: Sequence[str], y: str = "y", fold: str = "fold", out: str = "pred") -> tuple[DataFrame, dict]:
    """Selection-honest choice: each fold uses the option that is best on the other folds (ties: declared first)."""
    s = option_losses(df, options, y, [fold]).collect()
    folds = sorted({r[fold] for r in s})
    picks = {}
    for k in folds:
        score = {o: sum(r["sse"] for r in s if r["option"] == o and r[fold] != k) / max(1, sum(r["n"] for r in s if r["option"] == o and r[fold] != k)) for o in options}
        picks[k] = min(options, key=lambda o: (round(score[o], 9), list(options).index(o)))
    return df.withColumn(out, by_value(fold, {k: F.col(o) for k, o in picks.items()})), picks


def full_choice(df: DataFrame, options: Sequence[str], y: str = "y") -> DataFrame:
    s = option_losses(df, options, y, []).withColumn("score", F.col("sse") / F.col("n")).withColumn("_k", F.lit(1))
    return pick_best(s, ["_k"], "option", "score", "ord").drop("_k")


def verdict(dmse, folds_better, resplit_mean, droptop, mechanism=None) -> Column:
    safe = (dmse < 0) & (folds_better >= 3) & (resplit_mean < 0) & (droptop < 0)
    bold = (F.lit(False) if mechanism is None else mechanism) & (dmse <= 0.5)
    return F.when(safe, "SAFE").when(bold, "BOLD").otherwise("FAIL")


def slot_class(dmse, folds_better, p_ge0, split_mean, droptop, score, best, rms_best, rms_min, near: float = 0.0132) -> Column:
    """Class of a candidate for a submission slot."""
    steady = (dmse < 0) & (folds_better >= 3) & (p_ge0 <= 0.5)
    close = steady & (score <= best + near)
    return (F.when(rms_min < 0.25, "SKIP").when(steady & (score < best), "SAFE")
            .when((dmse <= 0.42) & (score <= best + near) & (rms_best >= 0.5), "BOLD")
            .when(close & (split_mean < 0) & (droptop < 0), "NEAR-TIE(strict)").when(close, "NEAR-TIE").otherwise("no"))


def judge_recipes(df: DataFrame, y: str, base: Sequence[str], candidates: dict[str, Sequence[str]], key: str, stratum: str, test: Column, fold: str = "fold",
                  n_splits: int = 40, drop: int = 3) -> DataFrame:
    """Every figure of the slot rule computed from the rows, the class it gives, and the order of the candidates.

    A recipe is a cross-fitted column set. Its change against the base comes from its out-of-fold predictions (mean, folds better,
    mean without the rows that gain most), its stability from stratified re-splits, its score and its distance to the base from the
    ``test`` rows, and ``p_beat`` is the normal chance that the test error falls. Both the fits and the re-splits of all recipes are
    slices of one Gram each.
    """
    from ..functions.scalar import norm_cdf
    from .gram import design_exprs, gram, leave_out, predict_by_fold, solve
    from .resample import _by_replicate, _crossfit_rmse, stratified_splits

    union = list(dict.fromkeys([*base, *(c for xs in candidates.values() for c in xs)]))
    at = {n: [0, *[1 + union.index(x) for x in xs], len(union) + 1] for n, xs in {"": base, **candidates}.items()}
    rest = leave_out(gram(df, design_exprs(union, y), [fold]))
    pred = {n: predict_by_fold({k: solve(g[np.ix_(pos, pos)]) for k, g in rest.items()}, base if n == "" else candidates[n], fold) for n, pos in at.items()}
    d = df.select(key, fold, F.col(y).alias("_y"), test.alias("_test"), pred[""].alias("_base"),
                  F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), pred[n].alias("_pred")) for n in candidates])))
    d = d.withColumn("d", F.round(F.pow(F.col("_pred") - F.col("_y"), 2) - F.pow(F.col("_base") - F.col("_y"), 2), 9))
    on_test = lambda c: F.when(F.col("_test"), c)
    rms = lambda a, b: F.sqrt(F.avg(on_test(F.pow(F.col(a) - F.col(b), 2))))
    per = d.groupBy("candidate").agg(
        F.avg("d").alias("dmse"), F.sum("d").alias("_s"), F.count(F.lit(1)).alias("_n"), rms("_pred", "_y").alias("score"), rms("_base", "_y").alias("best"),
        rms("_pred", "_base").alias("rms"), F.avg(on_test(F.col("d"))).alias("_m"), (F.stddev_samp(on_test(F.col("d"))) / F.sqrt(F.count(on_test(F.col("d"))))).alias("_sd"))
    folds = d.groupBy("candidate", fold).agg(F.sum("d").alias("f")).groupBy("candidate").agg(F.sum((F.col("f") < 0).cast("bigint")).alias("folds_better"))
    top = d.withColumn("_r", F.row_number().over(W.partitionBy("candidate").orderBy("d", key))).where(F.col("_r") <= drop).groupBy("candidate").agg(F.sum("d").alias("_t"), F.count(F.lit(1)).alias("_k"))
    splits: dict = {n: [] for n in candidates}
    for gs in _by_replicate(gram(stratified_splits(df.select(key, stratum, y, *union), key, stratum, n_splits), design_exprs(union, y), ["split", "fold"])).values():
        mse = {n: _crossfit_rmse({k: g[np.ix_(pos, pos)] for k, g in gs.items()}) ** 2 for n, pos in at.items()}
        for n in candidates:
            splits[n].append(mse[n] - mse[""])
    j = per.join(folds, "candidate").join(top, "candidate").withColumns({
        "rs_mean": by_value("candidate", {n: float(np.mean(v)) for n, v in splits.items()}), "p_ge0": by_value("candidate", {n: float(np.mean(np.array(v) >= 0)) for n, v in splits.items()}),
        "droptop": (F.col("_s") - F.col("_t")) / (F.col("_n") - F.col("_k")), "p_beat": norm_cdf(-F.col("_m") / F.col("_sd"))})
    c = {n: F.col(n) for n in ("dmse", "folds_better", "p_ge0", "rs_mean", "droptop", "score", "best", "rms")}
    j = j.withColumn("cls", slot_class(*c.values(), c["rms"]))
    rank = by_value("cls", {"SAFE": 0, "BOLD": 1, "NEAR-TIE(strict)": 2, "NEAR-TIE": 2}, 9)
    place = F.row_number().over(W.orderBy(rank, F.round("score", 4), "dmse", "candidate"))  # one row a candidate
    return j.select("candidate", "cls", *[x for n, x in c.items() if n != "best"], "best", "p_beat", place.alias("place"),
                    verdict(c["dmse"], c["folds_better"], c["rs_mean"], c["droptop"], c["rms"] >= 0.5).alias("verdict"))


def fold_report(df: DataFrame, new: str, base: str, y: str = "y", fold: str = "fold") -> DataFrame:
    """Per fold: changed rows, squared errors of both columns over them, their difference, whether it is better, both RMSEs."""
    moved = F.col(new) != F.col(base)
    sse = lambda c: F.coalesce(F.sum(F.when(moved, F.pow(F.col(c) - F.col(y), 2))), F.lit(0.0))
    root = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col(y), 2)))
    g = df.groupBy(fold).agg(F.sum(moved.cast("bigint")).alias("n_changed"), sse(base).alias("sse_base"), sse(new).alias("sse_new"), root(base).alias("rmse_base"), root(new).alias("rmse_new"))
    return g.withColumns({"dsse": F.col("sse_new") - F.col("sse_base"), "better": (F.col("n_changed") > 0) & (F.col("sse_new") < F.col("sse_base"))})


def top_contributors(df: DataFrame, new: str, base: str, n: int, key: str = "id", y: str = "y") -> DataFrame:
    """The rows whose squared error falls most (ties: smaller key), in order, with their gain and its share of all falls."""
    d = df.select(key, F.round(-loss_change(new, base, y), 9).alias("gain"))
    every = d.agg(F.sum(F.greatest("gain", F.lit(0.0)))).first()[0]
    top = d.orderBy(F.desc("gain"), key).limit(n)
    return top.select(F.row_number().over(W.orderBy(F.desc("gain"), key)).alias("place"), key, "gain", (F.col("gain") / every).alias("share"))


def probe_report(df: DataFrame, resid: str, probe: str, tercile: str, clean: Column, fold: str = "fold") -> DataFrame:
    """One line per view of the rows (all, each tercile, clean rows by tercile): rows, correlation, RMSE before and after the probe,
    and over all rows the number of folds that get better."""
    before, after = F.sqrt(F.avg(F.pow(F.col(resid), 2))), F.sqrt(F.avg(F.pow(F.col(resid) - F.col(probe), 2)))
    d = df.select(fold, resid, probe, F.col(tercile).cast("string").alias("_t"), clean.alias("_c"))
    views = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("tercile "), F.col("_t")), F.when(F.col("_c"), F.concat(F.lit("clean tercile "), F.col("_t")))))
    g = d.withColumn("view", F.explode(views)).groupBy("view").agg(F.count(F.lit(1)).alias("n"), safe_corr(probe, resid).alias("corr"), before.alias("before"), after.alias("after"))
    folds = d.groupBy(fold).agg((after < before).cast("bigint").alias("b")).agg(F.sum("b").alias("folds_better")).withColumn("view", F.lit("all"))
    return g.join(folds, "view", "left")


def lane(df: DataFrame, new: str, base: str, y: str, looked_at: int, by: Sequence[str] = (), scale: float = 22.0) -> DataFrame:
    """Change share, rms change, harm ratio and selection bias of the changed rows, and the lane they lead to."""
    dp = F.col(new) - F.col(base)
    ch = F.abs(dp) > 1e-9
    d = loss_change(new, base, y)
    n = F.count(F.lit(1)).cast("double")
    g = df.groupBy(*by).agg(
        F.sum(ch.cast("bigint")).alias("rows"), F.avg(ch.cast("double")).alias("f"), F.sqrt(F.avg(F.when(ch, dp * dp))).alias("c"),
        F.avg(F.when(ch, F.pow(F.col(y) - F.col(base), 2))).alias("mse_r"), (F.avg(d) / scale).alias("delta"),
        (F.stddev_pop(d) / F.sqrt(n) / scale).alias("sd_tr"))
    bias = 0.7 * expected_max_bias(F.lit(looked_at)) * F.col("sd_tr")
    g = g.withColumns({"ratio": 8.66 * F.col("c") * F.sqrt(safe_div("f", "mse_r")), "bias": bias})
    tot = F.col("delta") + F.col("bias")
    name = F.when(tot > 0.66 * F.col("sd_tr"), "NO").when(F.col("ratio") >= 2.5, "FAST").when(F.col("ratio") < 1.0, "PIPELINE").otherwise("DANGER")
    return g.withColumns({"lane": name, "strict": tot <= -F.col("sd_tr")})


def step_table(df: DataFrame, steps: Sequence[tuple[str, str, int]], y: str, seen: Column, scale: float = 22.0) -> DataFrame:
    """The lane of every step (base, new, variants looked at) from the rows not ``seen``, beside what the seen rows then showed: their
    change, its error and its distance to the forecast. All steps share one pass."""
    pairs = F.array(*[F.struct(F.lit(f"{a}->{b}").alias("step"), F.lit(n).alias("looked_at"), F.col(a).cast("double").alias("_b"), F.col(b).cast("double").alias("_n")) for a, b, n in steps])
    d = df.select(F.col(y).alias("_y"), seen.alias("_seen"), F.inline(pairs)).withColumn("_d", loss_change("_n", "_b", "_y"))
    table = None
    for a, b, n in steps:
        one = lane(d.where(~F.col("_seen") & (F.col("step") == f"{a}->{b}")), "_n", "_b", "_y", n, ["step"], scale)
        table = one if table is None else table.unionByName(one)
    pub = d.where("_seen").groupBy("step").agg((F.avg("_d") / scale).alias("shown"), (F.stddev_pop("_d") / F.sqrt(F.count(F.lit(1))) / scale).alias("sd_shown"))
    return table.join(pub, "step").withColumn("z", safe_div(F.col("shown") - F.col("delta"), "sd_shown"))


def expected_public_change(train: DataFrame, test: DataFrame, new: str, base: str, y: str, stratum: str, share: float, shrink: float = 0.47) -> DataFrame:
    """Expected score change: training rows' gain per stratum (hypothesis) against a pure-noise change (null)."""
    dse = loss_change(new, base, y)
    moved = F.col(new) != F.col(base)
    tr = train.groupBy(stratum).agg(F.avg(F.when(moved, dse)).alias("m"), F.var_pop(F.when(moved, dse)).alias("v"), F.sum(moved.cast("bigint")).alias("k"),
                                    F.var_pop(F.col(base) - F.col(y)).alias("s2"))
    dd = F.col(new) - F.col(base)
    te = test.groupBy(stratum).agg(F.sum(moved.cast("bigint")).alias("nte"), F.sum(dd * dd).alias("q"))
    n = test.count() * share
    j = te.join(tr, stratum)
    m, v = F.when(F.col("k") >= 2, F.col("m")).otherwise(0.0), F.when(F.col("k") >= 2, F.col("v")).otherwise(0.0)
    e, en = F.sum(share * F.col("nte") * m) / n, F.sum(share * F.col("q")) / n
    return j.agg(e.alias("hyp"), (F.sqrt(F.sum(share * F.col("nte") * v)) / n).alias("hyp_sd"), en.alias("null"),
                 (F.sqrt(F.sum(share * 4 * F.col("q") * F.col("s2"))) / n).alias("null_sd"), (en + shrink * (e - en)).alias("expect"))


def reading_table(df: DataFrame, parents: dict[str, str], y: str, s2: str, share: float) -> DataFrame:
    """Per file against its parent: size of the step, observed change, null expectation and sd, z, best multiple."""
    steps = F.array(*[F.struct(F.lit(b).alias("file"), F.lit(a).alias("base"), (F.col(b) - F.col(a)).alias("d"), loss_change(b, a, y).alias("o")) for b, a in parents.items()])
    x = F.pow("d", 2)
    g = df.select(s2, F.inline(steps)).groupBy("file", "base").agg(
        F.sum((F.abs("d") > 1e-9).cast("bigint")).alias("n_changed"), F.avg(x).alias("m2"), F.avg("o").alias("obs"), F.var_samp(x).alias("vx"),
        F.sum(4 * x * F.col(s2)).alias("e"), F.count(F.lit(1)).alias("n"))
    n = F.col("n") * share
    sd = F.sqrt(F.col("vx") / n * (1 - share) + share * F.col("e") / (n * n))
    return g.select("file", "base", "n_changed", "obs", "m2", sd.alias("sd"), ((F.col("obs") - F.col("m2")) / sd).alias("z"),
                    safe_div(-(F.col("obs") - F.col("m2")), 2 * F.col("m2")).alias("best_multiple"))


def similarity_guard(df: DataFrame, cand: str, earlier: Sequence[str], rows: Column) -> DataFrame:
    """Rms distance to every earlier file on a row group, and whether it is the smallest."""
    g = df.where(rows).agg(*[F.sqrt(F.avg(F.pow(F.col(cand) - F.col(e), 2))).alias(e) for e in earlier])
    low = F.least(*[F.col(e) for e in earlier])
    return g.select(F.inline(F.array(*[F.struct(F.lit(e).alias("file"), F.col(e).alias("rms"), (F.col(e) == low).alias("nearest")) for e in earlier])))


def health_gate(df: DataFrame, members: Sequence[str], ref: str, least: float) -> DataFrame:
    g = df.agg(*[safe_corr(m, ref).alias(m) for m in members])
    return g.select(F.inline(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("corr"), (F.coalesce(F.col(m), F.lit(0.0)) >= least).alias("ok")) for m in members])))


def variant_fidelity(long: DataFrame, variant: str, value: str, target: str) -> DataFrame:
    e = F.col(value) - F.col(target)
    g = long.groupBy(variant).agg(safe_corr(value, target).alias("corr"), rmse(value, target).alias("rmse"), F.avg(e).alias("bias"), F.count(F.lit(1)).alias("n"))
    best = g.agg(F.max_by(variant, F.struct(F.round("corr", 9), -F.col(variant))).alias("_b"), F.lit(1).alias("_k"))
    return g.withColumn("_k", F.lit(1)).join(best, "_k").withColumn("chosen", F.col(variant) == F.col("_b")).drop("_k", "_b")


def all_bars(df: DataFrame, bars: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in bars.items()]).withColumn("passed", add_all([c.cast("int") for c in bars.values()]) == len(bars))


def run_pick(scores: DataFrame, run: str, metrics: dict[str, float], base: Sequence[str]) -> DataFrame:
    """Runs against bars relative to the mean of the base runs; the best qualifying run by the first metric."""
    b = scores.where(F.col(run).isin(list(base))).agg(*[F.avg(m).alias(m) for m in metrics]).first()
    ok = add_all([(F.col(m) >= b[m] + d).cast("int") for m, d in metrics.items()]) == len(metrics)
    return scores.where(~F.col(run).isin(list(base))).withColumn("qualifies", ok)


def picked(qualified: DataFrame, run: str, metric: str) -> DataFrame:
    """The pick among runs with bars (``run_pick``): the run with the best first metric (ties: later name), if it qualifies, else none."""
    best = qualified.agg(F.max(F.struct(F.col(metric), F.col(run), F.col("qualifies"))).alias("b"), F.count(F.lit(1)).alias("runs"), F.sum(F.col("qualifies").cast("bigint")).alias("qualifying"))
    return best.select(F.when(F.col("b.qualifies"), F.col(f"b.{run}")).otherwise("none").alias("pick"), "runs", F.coalesce("qualifying", F.lit(0)).cast("bigint").alias("qualifying"))


def composite_fidelity(df: DataFrame, y: str, terms: Sequence[str], variants: dict[str, dict[str, str]]) -> DataFrame:
    """How well variants of the terms of a linear formula reproduce it: (variant, corr, rmse, bias, term_corr, columns, chosen).

    The formula is fitted on the original terms and then fed each variant's columns; the ``composite`` takes for every term the
    variant that follows it best. All figures are quadratic forms of one Gram of all columns.
    """
    from .gram import gram, solve, total

    cols = list(dict.fromkeys([*terms, *(c for v in variants.values() for c in v.values())]))
    # sums of products of centred columns: plain ones lose the digits of a correlation as the rows grow
    every = [*cols, y]
    mid = df.dropna(subset=every).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(every)]).first()
    mid = np.array([m or 0.0 for m in mid], dtype=float)
    g = total(gram(df, [F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip(every, mid)]]))
    n = g[0, 0]
    pos = [0, *[1 + cols.index(t) for t in terms], len(cols) + 1]
    beta = solve(g[np.ix_(pos, pos)])

    def vector(columns: Sequence[str]) -> np.ndarray:
        v = np.zeros(len(g))
        v[0] = beta[0]
        for b, c, t in zip(beta[1:], columns, terms):
            v[1 + cols.index(c)] += b
            v[0] += b * (mid[cols.index(c)] - mid[cols.index(t)])
        return v

    def unit(c: str) -> np.ndarray:
        return np.eye(len(g))[1 + cols.index(c)]

    def corr(a: np.ndarray, b: np.ndarray) -> float:
        cov = lambda p, q: p @ g @ q / n - (g[0] @ p) * (g[0] @ q) / n / n
        return float(cov(a, b) / np.sqrt(cov(a, a) * cov(b, b)))

    whole = vector(terms)
    own = {name: {t: corr(unit(v[t]), unit(t)) for t in terms} for name, v in variants.items()}
    best = {t: max((own[name][t], name) for name in variants)[1] for t in terms}
    sets = {**variants, "composite": {t: variants[best[t]][t] for t in terms}}
    own["composite"] = {t: own[best[t]][t] for t in terms}
    rows = []
    for name, v in sets.items():
        f = vector([v[t] for t in terms])
        e = f - whole
        rows.append((name, corr(f, whole), float(np.sqrt(max(e @ g @ e, 0.0) / n)), float(g[0] @ e / n), [own[name][t] for t in terms], ",".join(v[t] for t in terms)))
    top = min(rows, key=lambda r: (-round(r[1], 9), r[0]))[0]  # equal ones by name
    return df.sparkSession.createDataFrame([(*r, r[0] == top) for r in rows], "variant string, corr double, rmse double, bias double, term_corr array<double>, columns string, chosen boolean")


def recipe_choice(build: Callable[[DataFrame, str], DataFrame], df: DataFrame, options: Sequence[str], y: str = "y", fold: str = "fold") -> tuple[DataFrame, dict]:
    """Nested choice among recipes: ``build(df, option)`` adds the option's out-of-fold column, named after it."""
    for o in options:
        df = build(df, o)
    return nested_choice(df, options, y, fold)
