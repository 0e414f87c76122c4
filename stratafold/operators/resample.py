"""Resampling tests. Every random choice is a hash of (seed, replicate, row key) or a keyed permutation of row numbers, so
results do not depend on partitioning and a lost task repeats the same draw. Rows are numbered once; a replicate then computes
where each row goes, looks the number up and streams into a partial aggregate. Multiplied rows are never sorted or stored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.mix import BITS, bit_sums, drawn_sums
from ..functions.permute import Shuffle, permuted
from ..functions.ranks import average_ranks, null_safe_join, row_numbers, running_sums
from ..functions.scalar import md5_below, md5_order
from .gram import design_exprs, gram, leave_out, solve
from .linear import probe_coefs
from ..session import written
from .metrics import safe_corr
from .ranking import unpivot


def replicate(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sign_flip(df: DataFrame, d: str, key: str, n: int = 20_000, seed: int = 0) -> DataFrame:
    """One-sided paired sign-flip test of mean(d) < 0: (observed, p).

    One number mixed of (seed, word, key) holds the signs of 31 flips; the sums of the flips are added up inside the tasks.
    """
    flips = bit_sums(df, key, d, range(-(-n // BITS)), seed).where(F.col("word") * BITS + F.col("j") < n)
    obs = df.agg(F.avg(d).alias("m"), F.sum(F.col(d).cast("double")).alias("all"), F.count(d).alias("rows")).first()
    m = (F.lit(obs["all"]) - 2 * F.col("s")) / F.lit(obs["rows"])
    return flips.agg(F.lit(obs["m"]).alias("observed"), ((1 + F.sum((m <= obs["m"] + 1e-12).cast("int"))) / (n + 1)).alias("p"))


LOOKUP_ROWS = 2_000_000  # larger tables of numbered values are joined by a shuffled hash table


def numbered(df: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """Adds ``_i``, the place of a row in its group by key (from 0), and ``_n``, the rows of the group; written once."""
    d = running_sums(df, list(group), [key], {"_one": F.lit(1).cast("bigint")})
    return written(d.withColumnRenamed("_one_before", "_i").withColumnRenamed("_one_total", "_n"), "numbered")


def look_up(many: DataFrame, values: DataFrame, group: Sequence[str], rows: int) -> DataFrame:
    """Joins numbered values (column ``_to`` and more) to multiplied rows without sorting either side."""
    v = values.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_to").alias("_at"), *[c for c in values.columns if c not in (*group, "_to")])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_to") == F.col("_at"))
    return many.join(F.broadcast(v) if rows <= LOOKUP_ROWS else v.hint("shuffle_hash"), on).drop("_to", "_at", *[f"_g{i}" for i in range(len(group))])


def shuffled(df: DataFrame, cols: Sequence[str], key: str, group: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """(rep, rows) with the columns ``cols`` permuted together inside each group, once per replicate; the key is dropped."""
    d = numbered(df, key, group)
    values = d.select(*group, F.col("_i").alias("_to"), *cols)
    many = permuted(d.drop(*cols, *([] if key in group else [key])), "_i", "_n", range(n), "_to", seed, drop=True)
    return look_up(many, values, group, d.count())


CHUNK = 4096  # consecutive values in one row
HELD = 1 << 26  # values that one task holds at most
RUN = 1 << 17  # rows that a task multiplies at a time


def _blocks(spark, rows: int, wide: int) -> tuple[int, int, int]:
    """Values a block, blocks of values and blocks of rows of a table."""
    size = max(1, HELD // (wide * CHUNK)) * CHUNK
    held = max(1, -(-rows // size))
    return size, held, max(1, min(-(-2 * spark.sparkContext.defaultParallelism // held), -(-rows // CHUNK)))


def _met(rows: DataFrame, values: DataFrame, size: int, held: int, parts: int) -> DataFrame:
    """Values (_pos, _m) in their blocks and rows (_part, _block, _ord, ...) in one partition for each pair of blocks, values first."""
    chunks = values.groupBy(F.floor(F.col("_pos") / CHUNK).alias("_ord")).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("c"))
    chunks = chunks.select("_ord", F.flatten(F.col("c._m")).alias("_v"), F.floor(F.col("_ord") * CHUNK / size).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    both = chunks.unionByName(rows, allowMissingColumns=True)
    both = both.withColumn("_to", (F.col("_part") * held + F.col("_block")).cast("int"))
    order = [c for c in rows.columns if c not in ("_part", "_block", "_v", "_i", "_start", "_at")]
    return both.repartitionById(parts * held, F.col("_to")).sortWithinPartitions(F.col("_i").isNotNull(), *order)


def moved_sums(df: DataFrame, moved: Sequence[Column], fixed: Sequence[Column], key: str, group: Sequence[str], n: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(rep, by, s): per replicate the sums of all products of a moved and a fixed expression, the moved ones permuted together inside
    each group. ``s`` lists, for every moved expression and then for every product of two, the sums with each fixed one. No expression may
    be NULL.

    Values lie in blocks of at most ``HELD`` numbers; a task holds one, streams a block of rows past it and adds up what falls into it,
    so neither multiplied rows nor anything whole travels.
    """
    spark, by, wide = df.sparkSession, list(by), len(moved)
    d = df.select(*dict.fromkeys([key, *group, *by]), F.array(*[m.cast("double") for m in moved]).alias("_m"), F.array(*[f.cast("double") for f in fixed]).alias("_f"))
    d = numbered(d, key, group)
    if group:
        first = running_sums(d.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")), [], group, {"_s": F.col("_rows")})
        d = null_safe_join(d, first.select(*group, F.col("_s_before").alias("_start")), group)
    else:
        d = d.withColumn("_start", F.lit(0).cast("long"))
    total = d.count()
    size, held, parts = _blocks(spark, total, wide)
    pos = F.col("_start") + F.col("_i")
    values = d.select(pos.alias("_pos"), "_m")
    span = F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_n") - 1) / size))
    rows = d.select(F.floor(pos * parts / max(1, total)).cast("int").alias("_part"), F.explode(span).alias("_block"), F.col("_n").alias("_ord"), *by, F.col("_f").alias("_v"), "_i", "_start")
    pairs = [(i, j) for i in range(wide) for j in range(i, wide)]
    nf, reps = len(fixed), range(n)

    def run(batches):
        held_, base, sums, waiting = [], None, {}, []
        state = [None, 0]

        def flush():
            nonlocal held_
            if not waiting:
                return
            if isinstance(held_, list):
                held_ = np.ascontiguousarray(np.concatenate(held_).reshape(-1, wide).T)
            size_, label = state[0]
            x, start, f = (np.concatenate(c) for c in zip(*waiting))
            out = sums.setdefault(label, np.zeros((n, wide + len(pairs), nf)))
            shuffle, rows_ = Shuffle(x, size_, seed), held_.shape[1]
            start = start - base
            for r in reps:
                for part, to in shuffle.places(r):
                    to += start[part]
                    if held > 1:
                        inside = to.view(np.uint64) < rows_
                        to = np.where(inside, to, 0)
                    g = [v[to] * inside if held > 1 else v[to] for v in held_]
                    out[r] += np.stack([*g, *[g[i] * g[j] for i, j in pairs]]) @ f[part]
            waiting.clear()
            state[1] = 0

        for b in batches:
            late = np.asarray(b.column("_i").is_valid())
            cut = int((~late).sum())
            if cut:
                v = b.slice(0, cut)
                base = v.column("_ord")[0].as_py() * CHUNK if base is None else base
                held_.append(v.column("_v").flatten().to_numpy())
            b = b.slice(cut)
            if not b.num_rows:
                continue
            size_, labels = np.asarray(b.column("_ord")), list(zip(*[b.column(c).to_pylist() for c in by])) if by else [()] * b.num_rows
            x, start, f = np.asarray(b.column("_i")), np.asarray(b.column("_start")), b.column("_v").flatten().to_numpy().reshape(-1, nf)
            edges = [0, *[i for i in range(1, len(x)) if size_[i] != size_[i - 1] or labels[i] != labels[i - 1]], len(x)]
            for lo, hi in zip(edges, edges[1:]):
                own = int(size_[lo]), labels[lo]
                if own != state[0] or state[1] >= RUN:
                    flush()
                    state[0] = own
                waiting.append((x[lo:hi], start[lo:hi], f[lo:hi]))
                state[1] += hi - lo
        flush()
        for label, s in sums.items():
            cols = [pa.array([k] * n, kind) for k, kind in zip(label, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int32()), *cols, pa.array(s.reshape(n, -1).tolist(), pa.list_(pa.float64()))], ["rep", *by, "s"])

    kinds = [to_arrow_type(d.schema[c].dataType) for c in by]
    schema = StructType([StructField("rep", IntegerType()), *[d.schema[c] for c in by], StructField("s", ArrayType(DoubleType()))])
    got = _met(rows, values, size, held, parts).mapInArrow(run, schema)
    k = nf * (wide + len(pairs))
    return got.groupBy("rep", *by).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"))


def moved_grams(df: DataFrame, y: str, xs: Sequence[str], moved: Sequence[str], key: str, group: Sequence[str], n: int, fold: str = "fold", seed: int = 0) -> tuple[dict, dict]:
    """Grams [1, xs, y] of the folds as they are, and {replicate: {fold: Gram}} with the columns ``moved`` permuted together inside
    each group. A row with a NULL in what meets there is left out."""
    cols = design_exprs(xs, y)
    base = gram(df, cols, [fold])
    m, rest = [1 + list(xs).index(c) for c in moved], [i for i in range(len(cols)) if i == 0 or i > len(xs) or xs[i - 1] not in moved]
    full = lambda cs: reduce(lambda a, b: a & b, [c.isNotNull() for c in cs], F.lit(True))
    mv, fx = [cols[i] for i in m], [cols[i] for i in rest]
    keep = lambda cs: lambda c: F.when(full(cs), c.cast("double")).otherwise(0.0)
    # sums with a flag for a whole row instead of the constant; a product of two fixed columns is a fixed one as well
    pairs = [(i, j) for i in range(len(fx)) for j in range(i, len(fx))]
    moved_ = [keep(mv)(F.lit(1.0)), *map(keep(mv), mv)]
    fixed = [keep(fx)(fx[i] * fx[j]) for i, j in pairs]
    if df.where(~full(mv)).isEmpty():
        moved_, fixed = moved_[1:], fixed[: len(fx)]  # the products with the constant, and what does not move is known
    gaps = len(moved_) > len(m)
    out: dict = {}
    for r in moved_sums(df, moved_, fixed, key, group, n, [fold], seed).collect():  # folds x replicates
        s = np.array(r["s"]).reshape(-1, len(fixed))
        g = base[(r[fold],)].copy() if (r[fold],) in base else np.zeros((len(cols), len(cols)))
        if gaps:
            for k, (i, j) in enumerate(pairs):
                g[rest[i], rest[j]] = g[rest[j], rest[i]] = s[0, k]
        first, w = (1, len(m) + 1) if gaps else (0, len(m))
        both = {p: w + k for k, p in enumerate((i, j) for i in range(w) for j in range(i, w))}
        for i, p in enumerate(m):
            g[p, rest] = g[rest, p] = s[first + i, : len(rest)]
            for j in range(i, len(m)):
                g[p, m[j]] = g[m[j], p] = s[both[first + i, first + j], 0]
        out.setdefault(r["rep"], {})[(r[fold],)] = g
    return base, out


def _by_replicate(grams: dict) -> dict:
    """{replicate: {fold key: Gram}} of Grams keyed by (replicate, fold)."""
    out: dict = {}
    for k, g in grams.items():
        out.setdefault(k[0], {})[k[1:]] = g
    return out


def _crossfit_rmse(gs: dict) -> float:
    sse = sum(float(v @ gs[k] @ v) for k, g in leave_out(gs).items() for v in [np.r_[-solve(g), 1.0]])
    return float(np.sqrt(sse / sum(g[0, 0] for g in gs.values())))


def refit_permutation(df: DataFrame, y: str, xs: Sequence[str], shuffle: str, key: str, group: Sequence[str], n: int = 2000, fold: str = "fold", seed: int = 0) -> DataFrame:
    """Permutation test with a full cross-fit per shuffle: p of the observed out-of-fold error."""
    base, moved = moved_grams(df, y, xs, [shuffle], key, group, n, fold, seed)
    obs, null = _crossfit_rmse(base), [_crossfit_rmse(gs) for gs in moved.values()]
    p = (1 + sum(e <= obs for e in null)) / (len(null) + 1)
    return df.sparkSession.createDataFrame([(obs, float(np.mean(null)), p)], "observed double, null_mean double, p double")


def probe_gain(gs: dict, base: int, extra: int, alphas: Sequence[float]) -> float:
    """Fall of the out-of-fold RMSE by a nested probe, from the Grams [1, base, extra, y] of the folds."""
    base_w, probe_w = probe_coefs(gs, gs, base, extra, alphas)
    sse = np.zeros(2)
    for k, g in gs.items():
        for i, probe in enumerate((0.0, 1.0)):
            v = np.r_[-base_w[k], -probe * probe_w[k][1:], 1.0]
            v[0] -= probe * probe_w[k][0]
            sse[i] += float(v @ g @ v)
    rmse = np.sqrt(sse / sum(g[0, 0] for g in gs.values()))
    return float(rmse[0] - rmse[1])


def probe_permutation(df: DataFrame, y: str, base: Sequence[str], extra: Sequence[str], alphas: Sequence[float], key: str, n: int = 20, fold: str = "fold", seed: int = 0) -> DataFrame:
    """Null of a leak-free residual probe: its columns are permuted together over all rows and the whole nested probe is
    refitted, every replicate from its own Grams of the folds."""
    size = len(base), len(extra)
    own, moved = moved_grams(df, y, [*base, *extra], extra, key, [], n, fold, seed)
    obs, null = probe_gain(own, *size, alphas), [probe_gain(gs, *size, alphas) for gs in moved.values()]
    p = (1 + sum(e >= obs for e in null)) / (len(null) + 1)
    return df.sparkSession.createDataFrame([(obs, float(np.mean(null)), float(np.max(null)), p)], "observed double, null_mean double, null_max double, p double")


def max_correlation_null(df: DataFrame, cols: Sequence[str], y: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Largest |rank correlation| over the features against its permutation null."""
    long = unpivot(df, [key], [*cols, y]).where("value is not null")
    wide = average_ranks(long, ["feature"], "value", "_r").groupBy(key).pivot("feature", [*cols, y]).agg(F.first("_r"))
    d = written(wide.select(key, *[F.col(c).alias(f"r_{c}") for c in cols], F.col(y).alias("ry")), "ranks")
    best = F.greatest(*[F.abs(F.coalesce(safe_corr(f"r_{c}", "ry"), F.lit(0.0))) for c in cols])
    obs = d.agg(best.alias("m")).first()["m"]
    # sums of centred ranks; a flag of its own says where a rank is missing
    mid = d.agg(*[F.avg(c).alias(c) for c in d.columns if c != key]).first()
    flag = lambda c: F.col(c).isNotNull().cast("double")
    at = lambda c: F.coalesce(F.col(c) - F.lit(mid[c]), F.lit(0.0))
    whole = d.where(F.col("ry").isNull()).isEmpty()
    moved = [at("ry")] if whole else [at("ry"), flag("ry")]
    fixed = [e for c in cols for e in (flag(f"r_{c}"), at(f"r_{c}"), at(f"r_{c}") * at(f"r_{c}"))]
    s = lambda i, j: F.col("s")[i * len(fixed) + j]
    sums = moved_sums(d, moved, fixed, key, [], n, seed=seed)
    if whole:
        own = d.agg(*[F.sum(e).alias(f"e{j}") for j, e in enumerate(fixed)]).first()

    def against(k: int) -> Column:
        have, a, a2 = (F.lit(own[3 * k + j]) if whole else s(1, 3 * k + j) for j in range(3))
        r, r2, ar = s(0, 3 * k), s(len(moved), 3 * k), s(0, 3 * k + 1)
        va, vr = a2 / have - (a / have) ** 2, r2 / have - (r / have) ** 2
        return F.abs(F.when((have > 0) & (va > 0) & (vr > 0), (ar / have - a / have * (r / have)) / F.sqrt(va * vr)).otherwise(0.0))

    null = sums.select("rep", F.greatest(*map(against, range(len(cols)))).alias("m"))
    return null.agg(F.lit(obs).alias("observed"), F.percentile("m", 0.5).alias("null_median"), F.percentile("m", 0.95).alias("null_95"),
                    ((1 + F.sum((F.col("m") >= obs).cast("int"))) / (n + 1)).alias("p"))


def bootstrap(df: DataFrame, key: str, sums: dict[str, Column], stat: Column, n: int = 2000, lo: float = 0.05, hi: float = 0.95, seed: int = 0) -> DataFrame:
    """Interval of any function ``stat`` of weighted sums; ``sums`` names the expressions that the multiplicities weigh. Rows sharing
    ``key`` are drawn together, so a source id as key gives the cluster bootstrap."""
    reps = drawn_sums(df, key, sums, range(n), seed=seed).select(stat.alias("s"))
    return reps.agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.percentile("s", lo).alias("lo"), F.percentile("s", hi).alias("hi"),
                    F.avg((F.col("s") >= 0).cast("double")).alias("p_ge0"))


def rmse_difference(new: str, base: str, y: str) -> tuple[dict[str, Column], Column]:
    """Sums and statistic of ``bootstrap``."""
    e = lambda c: F.pow(F.col(c) - F.col(y), 2)
    return {"w": F.lit(1.0), "new": e(new), "base": e(base)}, F.sqrt(F.col("new") / F.col("w")) - F.sqrt(F.col("base") / F.col("w"))


def stratified_splits(df: DataFrame, key: str, stratum: str, n: int, k: int = 5, seed: int = 0) -> DataFrame:
    """Every row once per re-split (``split``, ``fold``): a stratum is numbered once and dealt anew by a keyed permutation of its
    numbers, so its folds never differ by more than one row."""
    d = numbered(df, key, [stratum])
    return permuted(d, "_i", "_n", range(n), "_to", seed, drop=True).withColumn("fold", (F.col("_to") % k).cast("int")).withColumnRenamed("rep", "split").drop("_to")


def resplit_gain(df: DataFrame, y: str, base_xs: Sequence[str], new_xs: Sequence[str], key: str, stratum: str, n: int = 40, seed: int = 0) -> DataFrame:
    """MSE(new) - MSE(base) of cross-fitted recipes over stratified re-splits: mean, sd, share >= 0.

    The split id is one more group of the Gram, and both recipes are slices of the same Gram.
    """
    both = list(dict.fromkeys([*base_xs, *new_xs]))
    splits = stratified_splits(df.select(key, stratum, y, *both), key, stratum, n, seed=seed)
    per_split = _by_replicate(gram(splits, design_exprs(both, y), ["split", "fold"]))
    at = [[0, *[1 + both.index(x) for x in xs], len(both) + 1] for xs in (base_xs, new_xs)]
    d = np.array([_crossfit_rmse({k: g[np.ix_(at[1], at[1])] for k, g in gs.items()}) ** 2 - _crossfit_rmse({k: g[np.ix_(at[0], at[0])] for k, g in gs.items()}) ** 2
                  for _, gs in sorted(per_split.items())])
    return df.sparkSession.createDataFrame([(float(d.mean()), float(d.std()), float((d >= 0).mean()))], "mean double, sd double, p_ge0 double")


def subset_noise(df: DataFrame, d: str, key: str, share: float, n: int, seed: int = 0) -> DataFrame:
    """Spread of a paired mean over random subsets holding about ``share`` of the rows."""
    r = replicate(df.select(key, d), n).where(md5_below(share, seed, F.col("rep"), F.col(key)))
    return r.groupBy("rep").agg(F.avg(d).alias("m")).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))


def ks_statistic(df: DataFrame, value: str, second: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p, from bucketed running counts."""
    pre = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.sum((~second).cast("bigint")).alias("a"), F.sum(second.cast("bigint")).alias("b"))
    from ..functions.ranks import running_sums

    r = running_sums(pre, [], [value], {"a": F.col("a"), "b": F.col("b")})
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total"))
    g = r.agg(F.max(gap).alias("d"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    series = sum(((-1) ** (k - 1) * 2 * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 30)), F.lit(0.0))
    return g.select("d", "n1", "n2", F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("p"))


def neighbour_mean_correlation(nb: DataFrame, values: DataFrame, key: str = "id", value: str = "r") -> DataFrame:
    """Correlation of a row's residual with the mean residual of its nearest neighbours."""
    v = values.select(F.col(key).alias("nb"), F.col(value).alias("_v"))
    m = nb.join(v, "nb").groupBy(key).agg(F.avg("_v").alias("_m"))
    return m.join(values.select(key, value), key).agg(safe_corr(value, "_m").alias("stat"), F.count(F.lit(1)).alias("n"))


def neighbour_null(nb: DataFrame, values: DataFrame, n: int = 300, key: str = "id", value: str = "r", seed: int = 0) -> DataFrame:
    """The statistic of ``neighbour_mean_correlation`` against residuals permuted over all rows: (stat, n, null_95, p).

    The neighbour lists stay; a replicate looks up the number that stands at a row's and at its neighbours' places.
    """
    d = numbered(values.select(key, value), key, [])
    nb = written(nb.select(key, "nb"), "neighbours")
    total = d.count()
    at = d.select(F.col(key).alias("nb"), F.col("_i"), "_n")
    near, own = nb.join(at, "nb"), d.join(nb.select(key).distinct(), key, "left_semi")
    if total <= HELD:
        null = _neighbour_sums(d, near, own, key, value, n, total, seed)
    else:
        near, own = near.select(key, F.lit(False).alias("own"), "_i", "_n"), own.select(key, F.lit(True).alias("own"), "_i", "_n")
        many = permuted(written(near.unionByName(own), "places"), "_i", "_n", range(n), "_to", seed, drop=True)
        many = look_up(many, d.select(F.col("_i").alias("_to"), F.col(value).alias("_v")), [], total)
        per = many.groupBy("rep", key).agg(F.max(F.when(F.col("own"), F.col("_v"))).alias("_r"), F.avg(F.when(~F.col("own"), F.col("_v"))).alias("_m"))
        null = per.groupBy("rep").agg(safe_corr("_r", "_m").alias("c"))
    obs = neighbour_mean_correlation(nb, values, key, value).first()
    return null.agg(F.lit(obs["stat"]).alias("stat"), F.lit(obs["n"]).cast("long").alias("n"), F.percentile("c", 0.95).alias("null_95"), F.avg((F.col("c") >= obs["stat"]).cast("double")).alias("p"))


def _neighbour_sums(d: DataFrame, near: DataFrame, own: DataFrame, key: str, value: str, n: int, total: int, seed: int) -> DataFrame:
    """(rep, c) from sums that are added up inside tasks: a task holds the numbered values, and rows stream past with their own place and
    those of their neighbours."""
    mid = d.agg(F.avg(value)).first()[0] or 0.0  # sums of centred values lose no digits
    size, held, parts = max(CHUNK, -(-total // CHUNK) * CHUNK), 1, _blocks(d.sparkSession, total, 1)[2]
    values = d.select(F.col("_i").alias("_pos"), F.array(F.coalesce(F.col(value) - F.lit(mid), F.lit(float("nan")))).alias("_m"))
    places = near.groupBy(key).agg(F.collect_list("_i").alias("_at")).join(own.select(key, "_i"), key)
    rows = places.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part"), F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("_ord"),
                         F.concat(F.array("_i"), "_at").alias("_at"), F.lit(0).cast("long").alias("_i"))
    reps = range(n)

    def run(batches):
        held_, sums = [], np.zeros((n, 6))
        for b in batches:
            late = np.asarray(b.column("_i").is_valid())
            cut = int((~late).sum())
            if cut:
                held_.append(b.slice(0, cut).column("_v").flatten().to_numpy())
            b = b.slice(cut)
            if not b.num_rows:
                continue
            held_ = [np.concatenate(held_)] if len(held_) > 1 else held_
            to, many = b.column("_at").flatten().to_numpy(), np.asarray(b.column("_at").value_lengths())
            first = np.r_[0, np.cumsum(many)[:-1]]
            shuffle = Shuffle(to, total, seed)
            for r in reps:
                v = held_[0][np.concatenate([p for _, p in shuffle.places(r)])]
                known = ~np.isnan(v)
                v = np.where(known, v, 0.0)
                x, count = v[first], np.add.reduceat(known, first, dtype=np.int64) - known[first]
                both = known[first] & (count > 0)
                m = (np.add.reduceat(v, first) - x)[both] / count[both]
                x = x[both]
                sums[r] += (len(x), x.sum(), m.sum(), x @ x, m @ m, x @ m)
        if sums[:, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int32()), *map(pa.array, sums.T)], ["rep", *names])

    names = ["k", "x", "m", "xx", "mm", "xm"]
    got = _met(rows, values, size, held, parts).mapInArrow(run, "rep int, " + ", ".join(f"{c} double" for c in names))
    got = got.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])
    mean = lambda c: F.col(c) / F.col("k")
    vx, vm = mean("xx") - mean("x") ** 2, mean("mm") - mean("m") ** 2
    return got.select("rep", F.when((vx > 0) & (vm > 0), (mean("xm") - mean("x") * mean("m")) / F.sqrt(vx * vm)).alias("c"))


def random_group(df: DataFrame, flag: str, key: str, seed: int = 0) -> DataFrame:
    """Control flag: as many rows as the real group, chosen by hash order."""
    n = df.agg(F.sum(F.col(flag).cast("bigint")).alias("n")).first()["n"]
    r = row_numbers(df, [], [md5_order(seed, F.col(key)), F.col(key)], "_rn")
    return r.withColumn("control", F.col("_rn") <= n).drop("_rn")


def moments(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"), F.skewness(F.log(c)).alias("log_skew"))
