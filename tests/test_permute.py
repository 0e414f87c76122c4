"""Keyed permutations and the tests built on them, against plain loops."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions.permute import permutation, permuted
from stratafold.operators import gram as G
from stratafold.operators import linear as L
from stratafold.operators import resample as R


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 50, 101, 1500])
def test_every_replicate_is_a_bijection(n):
    for rep in range(50):
        assert sorted(permutation(np.arange(n), np.int64(n), rep, 3)) == list(range(n))


def test_replicates_are_spread():
    n, reps = 400, 4000
    x = np.arange(n)
    to = np.array([permutation(x, np.int64(n), r) for r in range(reps)])
    c = np.array([np.corrcoef(x, t)[0, 1] for t in to]) * np.sqrt(n - 1)
    assert abs(c.mean()) < 0.06 and abs(c.std() - 1) < 0.06
    hits = Counter(to[:, 17].tolist())
    assert len(hits) >= n - 2 and max(hits.values()) < 30
    assert len({tuple(t) for t in to}) == reps


def test_groups_of_different_sizes(spark):
    rows = [(g, i, n) for g, n in (("a", 3), ("b", 40), (None, 17)) for i in range(n)]
    got = permuted(spark.createDataFrame(rows, "g string, i long, n long"), "i", "n", range(7)).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.g, r.rep, r.n), []).append(r.to)
    assert len(seen) == 21 and all(sorted(v) == list(range(k[2])) for k, v in seen.items())


@pytest.mark.parametrize("lookup", [0, R.LOOKUP_ROWS])
def test_shuffled_moves_values_inside_groups(spark, monkeypatch, lookup):
    monkeypatch.setattr(R, "LOOKUP_ROWS", lookup)
    rows = [(i, None if i % 5 == 4 else i % 3, float(i), 10.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, fixed double, moved double")
    plain = {}
    for r in R.shuffled(df, ["moved"], "id", ["g"], 4).collect():
        plain.setdefault((r.rep, r.g), []).append((r.fixed, r.moved))
    for (_, g), pairs in plain.items():
        own = [x[2] for x in rows if x[1] == g]
        assert sorted(p[0] for p in pairs) == own and sorted(p[1] / 10 for p in pairs) == own
    assert len(plain) == 16 and any(a != b / 10 for pairs in plain.values() for a, b in pairs)


def test_splits_deal_every_stratum_evenly(spark):
    df = spark.range(503).select(F.col("id"), F.when(F.col("id") % 7 < 5, "big").when(F.col("id") % 7 < 6, "small").alias("g"))
    d = R.stratified_splits(df, "id", "g", 40)
    n = d.groupBy("split", "g", "fold").count().groupBy("split", "g").agg((F.max("count") - F.min("count")).alias("d"), F.count(F.lit(1)).alias("k"))
    assert n.where("d > 1 or k <> 5").isEmpty() and n.count() == 120
    assert d.groupBy("split").agg(F.countDistinct("id").alias("n")).where("n <> 503").isEmpty()


def test_probe_permutation_equals_refits_of_permuted_columns(spark):
    r = np.random.default_rng(1)
    n = 200
    x, z = r.normal(size=(n, 2)), r.normal(size=n)
    y = x[:, 0] + 0.6 * z + r.normal(size=n)
    df = spark.createDataFrame([(i, i % 5, *map(float, (*x[i], z[i], y[i]))) for i in range(n)], "id long, fold int, a double, b double, z double, y double")
    alphas = [0.1, 1.0, 10.0]
    got = R.probe_permutation(df, "y", ["a", "b"], ["z"], alphas, "id", 6).first()

    def gain(zz):
        gs = {}
        for k in range(5):
            m = np.column_stack([np.ones(n), x, zz, y])[np.arange(n) % 5 == k]
            gs[(k,)] = m.T @ m
        return R.probe_gain(gs, 2, 1, alphas)

    null = [gain(z[permutation(np.arange(n), np.int64(n), rep)]) for rep in range(6)]
    assert got.observed == pytest.approx(gain(z)) and got.null_mean == pytest.approx(np.mean(null)) and got.null_max == pytest.approx(max(null))
    # and the gain itself equals predictions row by row
    d = L.residual_probe(df, "y", ["a", "b"], ["z"], alphas).toPandas()
    e = np.sqrt(((d.y - d.base_pred) ** 2).mean()) - np.sqrt(((d.y - d.base_pred - d.probe) ** 2).mean())
    assert got.observed == pytest.approx(e)


def test_neighbour_null_equals_a_loop(spark):
    r = np.random.default_rng(2)
    n = 80
    v = r.normal(size=n)
    near = {i: [(i + j) % n for j in (1, 2, 5)] for i in range(n)}
    nb = spark.createDataFrame([(i, j) for i, js in near.items() for j in js], "id long, nb long")
    got = R.neighbour_null(nb, spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, r double"), 20).first()

    def stat(p):
        return np.corrcoef(p, [p[near[i]].mean() for i in range(n)])[0, 1]

    null = np.array([stat(v[permutation(np.arange(n), np.int64(n), rep)]) for rep in range(20)])
    assert got.stat == pytest.approx(stat(v)) and got.n == n
    assert got.null_95 == pytest.approx(np.quantile(null, 0.95)) and got.p == pytest.approx((null >= stat(v)).mean())


def test_wide_gram_is_planned_quickly_and_drops_null_rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 64))
    rows = [(i, i % 3, [None if (i, j) in ((4, 7), (9, 63)) else float(x[i, j]) for j in range(64)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, fold int, e array<double>")
    df = df.select("fold", *[F.col("e")[j].alias(f"c{j}") for j in range(64)])
    t = time.time()
    got = G.gram(df, [f"c{j}" for j in range(64)], ["fold"])
    assert time.time() - t < 60
    for k in range(3):
        own = x[[i for i in range(50) if i % 3 == k and i not in (4, 9)]]
        assert np.allclose(got[(k,)], own.T @ own)


def test_mixed_numbers_equal_their_sql_and_are_spread():
    import duckdb

    from stratafold.functions import mix as M

    key = np.array([0, 1, 2, 5, 17, 10**6, 2**33 + 5, -3])
    con = duckdb.connect()
    con.execute("create table t as select unnest([0, 1, 2, 5, 17, 1000000, 8589934597, -3]) as k, r from (select unnest(range(0, 9)) as r)")
    got = {(k, r): h for k, r, h in con.execute(M.mixed_sql("t", "r", "k", seed=4)).fetchall()}
    assert all(got[int(k), r] == int(h) for r in range(9) for k, h in zip(key, M.mix(key, r, 4)))
    n = 4000
    u = np.array([M.mix(np.arange(n) * 4 + 1, r) for r in range(150)]) / 2**31
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    c = np.corrcoef(u)[np.triu_indices(150, 1)] * np.sqrt(n)
    assert abs(c.std() - 1) < 0.05 and np.abs(c).max() < 6


def test_draws_are_poisson_counts(spark):
    from stratafold.functions.mix import draws

    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, cast(id as string)) as s")
    w = draws(df, "id", range(20), "w", poisson=True).toPandas().w
    assert len(w) == 60_000 and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert draws(df, "s", range(2), "w", poisson=True).count() == 6000  # other keys are hashed, a null key is a key


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_fisher_equals_a_sum_of_factorials(block):
    from math import comb, lgamma

    from stratafold.operators.metrics import fisher_exact

    r = np.random.default_rng(4)
    for _ in range(60):
        a, b, c, d = (int(x) for x in r.integers(0, 30, 4))
        lo, hi = max(0, a + c - c - d), min(a + b, a + c)
        w = {k: comb(a + b, k) * comb(c + d, a + c - k) for k in range(lo, hi + 1)}
        assert fisher_exact(a, b, c, d, block) == pytest.approx(sum(x for x in w.values() if x <= w[a] * (1 + 1e-7)) / sum(w.values()))
    if block > 3:
        a, b, c, d = 400_300, 599_700, 401_000, 599_000
        lf = np.vectorize(lgamma)
        k = np.arange(a - 20_000, a + 20_001)
        lp = lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lf(k + 1) - lf(a + b - k + 1) - lf(a + c - k + 1) - lf(c + d - a - c + k + 1)
        p = np.exp(lp)
        assert fisher_exact(a, b, c, d) == pytest.approx(p[p <= p[20_000] * (1 + 1e-7)].sum(), rel=1e-5)
        assert 0 < fisher_exact(10**9, 10**9, 10**9 + 90_000, 10**9 - 90_000) < 0.01
        assert fisher_exact(0, 0, 3, 4) == 1.0 and fisher_exact(10**9, 0, 0, 10**9) == 0.0


def test_nested_predictions_do_not_see_their_folds(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 4, float(r.normal()), float(r.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, fold int, x double, y double")
    changed = spark.createDataFrame([(i, f, x, y + 100 if f in (1, 2) else y) for i, f, x, y in rows], df.schema)
    one, two = ({(p.id, p.outer): p.pred for p in L.nested_predictions(d, "y", ["x"], [0.1, 1.0]).collect()} for d in (df, changed))
    assert len(one) == 320
    for (i, outer), p in one.items():
        unseen = {i % 4, outer} == {1, 2}
        assert (two[i, outer] == pytest.approx(p)) == unseen


def test_turned_lines_have_no_holes(spark):
    from stratafold.operators import raster as RA

    px = spark.createDataFrame([(0, y, x) for y in range(9) for x in range(13)], "img long, y int, x int")
    for angle in (0.0, np.pi / 2, np.pi / 4, 0.47, 2.1):
        lines = {}
        for p in RA.rotated(px, angle).collect():
            lines.setdefault(p.y, []).append(p.x)
        total = sum(map(len, lines.values()))
        assert abs(total - 117) <= 12 and all(sorted(v) == list(range(min(v), max(v) + 1)) for v in lines.values())
