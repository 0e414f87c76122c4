"""Brute-force and property checks on small hand-made tables, with the multi-bucket paths forced on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratafold.functions import ranks as R
from stratafold.functions.scalar import norm_cdf
from stratafold.operators import blend, components, folds, gram, joins, linear, mixtures, raster, resample, sets, splines
from stratafold.operators.ranking import dihedral_maps
from stratafold.sources import readers, writers


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most of the rows, values have many ties."""
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"id": range(2000), "k": np.where(rng.random(2000) < 0.8, 1, rng.integers(2, 6, 2000)), "v": rng.integers(0, 400, 2000) / 7, "w": rng.random(2000) + 0.1})
    return d, spark.createDataFrame(d)


@pytest.mark.parametrize("thin", [8, 1 << 20])
def test_quantiles_match_numpy(hot, thin):
    pdf, df = hot
    got = {r["k"]: (r["a"], r["b"]) for r in R.quantiles(df, ["k"], "v", {"a": 0.1, "b": 2 / 3}, thin).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.v, [0.1, 2 / 3]))
    assert np.allclose(R.global_quantiles(df, "v", [0.25, 0.9], thin), np.quantile(pdf.v, [0.25, 0.9]))


@pytest.mark.parametrize("parts", [1, 16])
def test_row_numbers_do_not_depend_on_partitions(hot, parts):
    pdf, df = hot
    got = R.row_numbers(df.repartition(parts), ["k"], ["v", "id"], "rn", 16).toPandas().set_index("id").rn.sort_index()
    want = pdf.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got == want.sort_index()).all()


def test_average_ranks(hot):
    pdf, df = hot
    got = R.average_ranks(df, ["k"], "v", "r", 8).toPandas().set_index("id").r.sort_index()
    assert np.allclose(got, pdf.groupby("k").v.rank())


def test_folds_are_balanced(hot):
    pdf, df = hot
    f = folds.stratified_folds(df, "id", "v", thin=8).toPandas()
    assert f.groupby("bin").fold.value_counts().unstack().pipe(lambda t: (t.max(axis=1) - t.min(axis=1)).max()) <= 1
    g = folds.group_folds(df, "k", thin=8).toPandas()
    assert g.groupby("k").fold.nunique().max() == 1


def test_crossfit_matches_numpy(hot):
    pdf, df = hot
    d = df.withColumn("fold", (F.col("id") % 5).cast("int")).withColumn("y", F.col("v") * 2 + F.col("w"))
    p = gram.crossfit_ols(d, "y", ["w"]).toPandas()
    for k in range(5):
        tr, te = p[p.fold != k], p[p.fold == k]
        assert np.allclose(te.pred, np.polyval(np.polyfit(tr.w, tr.y, 1), te.w))


def test_wide_gram_equals_narrow(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    d = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(16)]).assign(fold=np.arange(300) % 3))
    g = gram.gram(d, [F.lit(1.0), *[f"c{i}" for i in range(16)]], ["fold"])
    z = np.c_[np.ones(300), x]
    for k in range(3):
        m = np.arange(300) % 3 == k
        assert np.allclose(g[(k,)], z[m].T @ z[m])


def test_nnls_meets_kkt():
    rng = np.random.default_rng(2)
    for _ in range(100):
        p, y = rng.normal(size=(30, 4)), rng.normal(size=30)
        a, b = p.T @ p, p.T @ y
        x = blend.nnls_gram(a, b)
        g = b - a @ x
        assert (x >= 0).all() and (g <= 1e-7).all() and abs(g @ x) < 1e-7


def test_quadratic_program_stays_on_simplex():
    rng = np.random.default_rng(3)
    for _ in range(50):
        p = rng.normal(size=(40, 4))
        h, f = p.T @ p, p.T @ rng.normal(size=40)
        x = blend.quadratic_program(h, f, np.ones((1, 4)), np.ones(1), np.eye(4), np.full(4, 0.25))
        assert abs(x.sum() - 1) < 1e-8 and (x > -1e-8).all()
        best = min(0.5 * w @ h @ w - f @ w for w in rng.dirichlet(np.ones(4), 2000))
        assert 0.5 * x @ h @ x - f @ x <= best + 1e-6


def test_ridge_nested_matches_direct_solution():
    rng = np.random.default_rng(4)
    x, y, f = rng.normal(size=(200, 3)), rng.normal(size=200), np.arange(200) % 4
    z = np.c_[np.ones(200), x, y]
    gs = {(k,): z[f == k].T @ z[f == k] for k in range(4)}
    alpha, w, _ = linear.ridge_nested(gs, [1.0])[(0,)]
    tr = x[f != 0]
    s = (tr - tr.mean(0)) / tr.std(0)
    b = np.linalg.solve(s.T @ s + np.eye(3), s.T @ (y[f != 0] - y[f != 0].mean()))
    assert alpha == 1.0 and np.allclose(w[1:], b / tr.std(0))


def test_knn_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    got = joins.knn(d, 4, leaf=40, chunk=40).toPandas().sort_values(["id", "rank"]).nb.to_numpy().reshape(300, 4)
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(dist, np.inf)
    assert (np.argsort(dist, 1)[:, :4] == got).all()


def test_radius_pairs_with_shared_positions(spark):
    rng = np.random.default_rng(6)
    y, x, v = rng.integers(0, 20, 200), rng.integers(0, 20, 200), rng.normal(size=200)
    d = spark.createDataFrame(pd.DataFrame({"img": 1, "cy": y.astype(float), "cx": x.astype(float), "v": v}))
    r = joins.radius_pair_sums(d, "img", "cy", "cx", 5.0, ["v"]).first()
    i, j = np.triu_indices(200, 1)
    near = (y[i] - y[j]) ** 2 + (x[i] - x[j]) ** 2 <= 25
    assert r["pairs"] == near.sum() and np.isclose(r["prod_v"], (v[i] * v[j])[near].sum())


def test_components_agree(spark):
    """Snake-shaped mask: the raster labelling and the graph algorithm find the same pieces."""
    m = np.zeros((8, 8), int)
    m[::2] = 1
    m[1, 7] = m[3, 0] = m[5, 7] = 1
    m[6, 3] = 0
    rows = [(1, y, x, int(m[y, x])) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "img bigint, y int, x int, m int")
    a = components.raster_components(px, F.when(F.col("m") == 1, 1).otherwise(-1)).where("comp is not null")
    v = px.where("m = 1").select("img", (F.col("y") * 8 + F.col("x")).alias("node"))
    adj = joins.adjacency(px.withColumn("s", F.struct((F.col("y") * 8 + F.col("x")).alias("n"), "m")), "s").where("l1.m = 1 AND l2.m = 1")
    b = components.connected_components(v, adj.select("img", F.col("l1.n").alias("a"), F.col("l2.n").alias("b")))
    left = {(r["y"] * 8 + r["x"]): r["comp"] for r in a.collect()}
    right = {r["node"]: r["comp"] for r in b.collect()}
    assert left == right and len(set(left.values())) == 2


def test_spline_basis_is_a_partition_of_unity(spark):
    d = spark.createDataFrame([(float(x),) for x in np.linspace(0, 10, 101)], "x double")
    b = splines.spline_basis("x", [0.0, 1.0, 3.0, 7.0, 10.0], last=True)
    s = np.array([r[0] for r in d.select(sum(b, F.lit(0.0))).collect()])
    assert len(b) == 7 and np.allclose(s, 1, atol=1e-4)


def test_mixture_finds_known_means(spark):
    rng = np.random.default_rng(7)
    v = np.r_[rng.normal(0.5, 0.05, 400), rng.normal(1.0, 0.05, 600)]
    d = spark.createDataFrame(pd.DataFrame({"img": 1, "v": v}))
    r = mixtures.entity_mixture(d, F.floor(F.col("v") / 0.02).cast("int"), 0.0, 0.02, 80, 0.08, 0.9).first()
    assert abs(r["mu_lo"] - 0.5) < 0.02 and abs(r["mu_hi"] - 1.0) < 0.02 and 0.6 < r["thr"] < 0.9 and abs(r["w_lo"] - 0.4) < 0.03


def test_dihedral_maps_invert():
    for m in dihedral_maps(4).values():
        assert sorted(m) == list(range(16))


def test_sign_flip_bounds_and_normal_cdf(spark):
    d = spark.createDataFrame([(i, -1.0 - i % 3) for i in range(60)], "id bigint, d double")
    assert 0 < resample.sign_flip(d, "d", "id", 99).first()["p"] <= 0.02
    assert abs(spark.range(1).select(norm_cdf(F.lit(1.96))).first()[0] - 0.9750021) < 1e-6


def test_overlapping_changes_fail(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id bigint, pred double")
    c = spark.createDataFrame([(1, 5.0)], "id bigint, pred double")
    with pytest.raises(joins.KeyViolation):
        sets.disjoint_changes(base, [c, c])


def test_chunk_with_a_wrong_sum_is_refused(spark, tmp_path):
    lines = ["# t chunk (2 rows)", "1,1.0", "2,2.0", "# sums v 4.0"]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    with pytest.raises(joins.KeyViolation):
        writers.ingest_chunk(spark, str(tmp_path / "c.txt"), ["v"])


def test_png_folder_becomes_pixels(spark, tmp_path):
    import struct
    import zlib

    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    part = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    raw = b"".join(b"\0" + r.tobytes() for r in grey)
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    (tmp_path / "TRAIN_7.png").write_bytes(png)
    p = readers.read_images(spark, str(tmp_path)).toPandas()
    assert (p.img == "TRAIN_7").all() and all(np.isclose(r.v * 255, grey[r.y, r.x]) for r in p.itertuples())


def test_smoothing_keeps_a_constant(spark):
    px = spark.createDataFrame([(1, y, x, 3.0) for y in range(8) for x in range(8)], "img bigint, y int, x int, v double")
    v = [r["v"] for r in raster.smooth(px, raster.gaussian_kernel(1.0, 3)).collect()]
    assert len(v) == 64 and np.allclose(v, 3.0)


@pytest.fixture(scope="module")
def holes(spark):
    """NULL keys, values, targets and sources beside ordinary rows."""
    rows = [(1, "a", 1.0, "s"), (2, None, 2.0, None), (3, "a", None, "s"), (4, None, None, "t"), (5, None, 2.0, None), (6, "b", 0.5, None)]
    return spark.createDataFrame(rows, "id int, k string, v double, src string")


@pytest.mark.parametrize("thin", [1, 1 << 20])
def test_null_rows_stay(holes, thin):
    n = holes.count()
    numbered = R.row_numbers(holes, ["k"], ["v", "id"], "rn", thin).collect()
    assert len(numbered) == n and {(r.k, r.rn) for r in numbered} == {("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 2), (None, 3)}
    ranked = {r.id: r.r for r in R.average_ranks(holes, ["k"], "v", "r", thin).collect()}
    assert ranked == {1: 1.0, 2: 1.5, 3: None, 4: None, 5: 1.5, 6: 1.0}
    assert folds.group_folds(holes, "src", thin=thin).count() == n
    assert folds.stratified_folds(holes, "id", "v", n_bins=2, k=2, thin=thin).count() == n
    assert folds.stratified_resplits(holes, "id", "k", 3).count() == 3 * n


def test_bucket_numbers_grow_with_the_group(spark):
    d = spark.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).alias("k"))
    assert R.bucketed(d, ["k"], ["id"], 2).where("k").select("_b").distinct().count() > 600
    assert R.bucketed(d, [], ["id"], 2).select("_b").distinct().count() > 2000


def test_columns_are_chosen_without_the_held_out_fold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = x[:, 1] + 0.5 * x[:, 4] + rng.normal(size=400)
    fold = np.arange(400) % 5
    names = [f"c{i}" for i in range(6)]

    def grams(y):
        d = np.c_[np.ones(400), x, y]
        return {(k,): d[fold == k].T @ d[fold == k] for k in range(5)}

    picks = linear.infold_columns(grams(y), names, 3.0, 4, 0.01)
    assert all(p[:2] == ["c1", "c4"] for p in picks.values())
    other = np.where(fold == 2, 50 * x[:, 0], y)
    assert linear.infold_columns(grams(other), names, 3.0, 4, 0.01)[2,] == picks[2,]

    def error(g, cols):  # the same score by refitting
        total, err = 0.0, 0.0
        for k in g:
            pos = [0, *[1 + c for c in cols], 7]
            err += linear.gram_sse(g[k][np.ix_(pos, pos)], linear.ridge_coefs((sum(g.values()) - g[k])[np.ix_(pos, pos)], [3.0])[0])
            total += g[k][0, 0]
        return err, total

    g = {k: v for k, v in grams(y).items() if k != (0,)}
    whole = sum(g.values())
    splits = [linear._Split(whole - v, v, 3.0) for v in g.values()]
    for chosen in ([], [1], [1, 4]):
        rest = [j for j in range(6) if j not in chosen]
        assert np.allclose(sum(s.errors(chosen, rest) for s in splits), [error(g, [*chosen, j])[0] for j in rest])
        for s in splits:
            if len(chosen) < 2:
                s.grow(chosen, [1, 4][len(chosen)])


def test_state_weights_are_the_best_simplex_vectors():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(500, 2))
    s = np.eye(2)[rng.integers(0, 2, 500)]
    y = np.where(s[:, 0] > 0, 0.3 * p[:, 0] + 0.7 * p[:, 1], 1.4 * p[:, 0] - 0.4 * p[:, 1]) + 0.01 * rng.normal(size=500)
    d = np.c_[s[:, [0]] * p, s[:, [1]] * p, y]
    w = blend.state_weights(d.T @ d, 2, 0.0)
    assert np.allclose(w, [[0.3, 0.7], [1.0, 0.0]], atol=0.01)
    even = blend.state_weights(d.T @ d, 2, 1e6)
    assert np.allclose(even[0], even[1], atol=1e-3)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(1, i, i + 1) for i in range(300)]
    hub = [(2, 7, i) for i in range(8, 500)]
    e = spark.createDataFrame(path + hub, "img int, a long, b long")
    v = e.selectExpr("img", "inline(array(struct(a as node), struct(b as node)))").distinct().unionByName(spark.createDataFrame([(3, 9)], "img int, node long"))
    got = components.connected_components(v, e)
    assert {(r[0], r[1]) for r in got.select("img", "comp").distinct().collect()} == {(1, 0), (2, 7), (3, 9)}
    assert got.count() == 301 + 493 + 1
