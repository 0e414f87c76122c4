"""Fit-and-apply queries."""

from pyspark.sql import functions as F

from ..functions.mix import mixed_sql, poisson_weight_sql
from ..functions.scalar import norm_cdf
from ..operators import blend as BL
from ..operators import blocks as B
from ..operators import boosting as BO
from ..operators import folds as FO
from ..operators import gram as G
from ..operators import linear as L
from ..operators import mixtures as MX
from ..operators import models as MD
from ..operators import splines as SP
from ..operators import variance as V
from ..operators import inference as INF
from ..operators import metrics as M
from .fixtures import blocks, files, members, regions, rounded, rounded_sql, rows, seq, table, train_rows, variants, with_ctes
from .registry import query

XS = ["x1", "x2", "x3", "x4", "x5"]
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
_KF = "k AS (SELECT DISTINCT fold FROM members)"


def two_term(y, a, b, cond, src="members"):
    """Leave-fold-out two-regressor least squares, closed form."""
    return f"""{_KF}, s AS (SELECT k.fold, covar_pop({a}, {y}) AS sa, covar_pop({b}, {y}) AS sb, var_pop({a}) AS va, var_pop({b}) AS vb, covar_pop({a}, {b}) AS ab,
 avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb FROM k JOIN {src} m ON m.fold <> k.fold WHERE {cond} GROUP BY k.fold),
c AS (SELECT fold, (sa * vb - sb * ab) / (va * vb - ab * ab) AS ca, (sb * va - sa * ab) / (va * vb - ab * ab) AS cb, my, ma, mb FROM s)"""


@query("fit01", rounded_sql("members", "id", f"""
WITH {two_term('y - p1', 'x4', 'q1', 'q1 < 26')}
SELECT id, CASE WHEN q1 < 26 THEN my + ca * (x4 - ma) + cb * (q1 - mb) ELSE 0 END AS offset_ FROM members JOIN c USING (fold)""", 5))
def fit01(spark, sf):
    m = members(spark, sf).withColumn("r", F.col("y") - F.col("p1"))
    d = G.crossfit_ols(m, "r", ["x4", "q1"], "offset_", fit=F.col("q1") < 26)
    return rounded(d.select("id", "offset_"), 5)


@query("fit02", rounded_sql("members", "id", f"""
WITH {_KF}, s AS (SELECT k.fold, regr_slope(x5, x4) AS b, regr_intercept(x5, x4) AS a FROM k JOIN members m ON m.fold <> k.fold GROUP BY k.fold)
SELECT id, x5 - (a + b * x4) AS x5_res FROM members JOIN s USING (fold)"""))
def fit02(spark, sf):
    return rounded(L.residualise(rows(spark, sf), "x5", "x4", "x5_res").select("id", "x5_res"))


@query("fit03", rounded_sql("members", "id", f"""
WITH {_KF}, g AS (SELECT *, y - p2 AS r FROM members WHERE q1 < 26),
s AS (SELECT k.fold, regr_slope(x1, x4) AS b, regr_intercept(x1, x4) AS a, avg(r) AS mr FROM k JOIN g ON g.fold <> k.fold GROUP BY k.fold),
e AS (SELECT s.fold, sum((x1 - a - b * x4) * (r - mr)) / sum(pow(x1 - a - b * x4, 2)) AS beta FROM s JOIN g ON g.fold <> s.fold GROUP BY s.fold)
SELECT id, CASE WHEN q1 < 26 THEN beta * (x1 - a - b * x4) ELSE 0 END AS offset_ FROM members JOIN s USING (fold) JOIN e USING (fold)""", 5))
def fit03(spark, sf):
    m = members(spark, sf).withColumn("r", F.col("y") - F.col("p2"))
    return rounded(L.readers_offset(m, {"x1": "x4"}, "r", F.col("q1") < 26, "offset_").select("id", "offset_"), 5)


@query("fit03_multi")
def fit03_multi(spark, sf):
    m = members(spark, sf).withColumn("r", F.col("y") - F.col("p2"))
    return rounded(L.readers_offset(m, {"x1": "x4", "x5": "x4", "q1": "q2"}, "r", F.col("q1") < 26, "offset_").select("id", "offset_"))


@query("fit04", rounded_sql("members", "id", f"""
WITH {_KF}, md AS (SELECT k.fold, median(q1) AS m FROM k JOIN members m ON m.fold <> k.fold WHERE x4 > 2 GROUP BY k.fold),
s AS (SELECT md.fold, m, avg(p1) AS c, regr_slope(y, p1) AS b FROM md JOIN members x ON x.fold <> md.fold WHERE x4 > 2 AND q1 < m GROUP BY md.fold, m)
SELECT id, CASE WHEN x4 > 2 AND q1 < m THEN c + (1 + 0.5 * (b / 0.98 - 1)) * (p1 - c) ELSE p1 END AS stretched FROM members JOIN s USING (fold)"""))
def fit04(spark, sf):
    return rounded(L.slope_stretch(members(spark, sf), "p1", "y", "q1", F.col("x4") > 2, 0.5, 0.98).select("id", "stretched"))


_HC1 = """
m AS (SELECT g, count(*) AS n, avg(p1) AS mx, var_pop(p1) AS vx, regr_slope(y, p1) AS b, regr_intercept(y, p1) AS a FROM members GROUP BY g),
h AS (SELECT g, n, b AS slope, sqrt(sum(pow((p1 - mx) * (y - a - b * p1), 2)) * n / (n - 2)) / (n * vx) AS se FROM members JOIN m USING (g) GROUP BY g, n, b, vx)"""


@query("fit05", rounded_sql("members", "g, n", f"""
WITH {_HC1}, t AS (SELECT avg(greatest(pow(slope - 1, 2) - se * se, 0)) AS t FROM h)
SELECT g, n, slope, se, t / (t + se * se) AS w, 1 + t / (t + se * se) * (slope - 1) AS shrunk FROM h, t"""))
def fit05(spark, sf):
    return rounded(L.shrunk_slopes(L.robust_slopes(members(spark, sf), ["g"], "p1", "y")))


@query("fit06", rounded_sql("members", "id", f"""
WITH {two_term('y', 'x1', 'x2', 'true')}
SELECT id, p1 + 0.5 * (my + ca * (x1 - ma) + cb * (x2 - mb) - p1) AS mixed FROM members JOIN c USING (fold)""", 5))
def fit06(spark, sf):
    d = G.crossfit_ols(members(spark, sf), "y", ["x1", "x2"], "f")
    return rounded(d.select("id", (F.col("p1") + 0.5 * (F.col("f") - F.col("p1"))).alias("mixed")), 5)


@query("fit06_terms")
def fit06_terms(spark, sf):
    """Seven terms and an intercept, mixed half and half with the base."""
    m = members(spark, sf).withColumns({"x12": F.col("x1") * F.col("x2"), "lx": F.log("x1")})
    d = G.crossfit_ols(m, "y", [*XS, "x12", "lx"], "f")
    return rounded(d.select("id", ((F.col("p1") + F.col("f")) / 2).alias("mixed")))


@query("fit07", rounded_sql("members", "id", f"""
WITH {_KF}, s AS (SELECT k.fold, regr_slope(ln(y), x1) AS b, regr_intercept(ln(y), x1) AS a, regr_syy(ln(y), x1) - regr_sxy(ln(y), x1) ** 2 / regr_sxx(ln(y), x1) AS sse, count(*) AS n FROM k JOIN members m ON m.fold <> k.fold GROUP BY k.fold)
SELECT id, exp(a + b * x1 + sse / n / 2) AS pred FROM members JOIN s USING (fold)""", 5))
def fit07(spark, sf):
    return rounded(L.log_smearing(rows(spark, sf), "x1", "y").select("id", "pred"), 5)


@query("fit08")
def fit08(spark, sf):
    return rounded(L.ridge_loo(rows(spark, sf), "y", XS, ALPHAS)[0].select("id", "fold", "pred"))


@query("fit09")
def fit09(spark, sf):
    return rounded(L.crossfit_ridge(rows(spark, sf), "y", XS, ALPHAS)[0].select("id", "fold", "pred"))


def vector_views(spark, sf):
    """Four views of 16 channels per vector, with a fold by source."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("e"))
    f = FO.group_folds(e.select("id"), "id")
    return e.join(f, "id")


@query("fit10")
def fit10(spark, sf):
    e = vector_views(spark, sf)
    views = [[F.col("e")[16 * v + c] for c in range(16)] for v in range(4)]
    mean = [sum(views[v][c] for v in range(4)) / 4 for c in range(16)]
    xs = [f"c{c}" for c in range(16)]
    between = e.select("id", "fold", "y", *[m.alias(x) for m, x in zip(mean, xs)])
    dev = e.select("fold", F.inline(F.array(*[F.struct(*[(views[v][c] - mean[c]).alias(xs[c]) for c in range(16)]) for v in range(4)])))
    return rounded(L.generalised_ridge(between, {"view": dev}, "y", xs, [0.0, 1.0, 10.0], [1.0, 10.0, 100.0])[0].select("id", "fold", "pred"))


def nnls2(where, by="k.fold", src="members", cond="m.fold <> k.fold"):
    """Two-member NNLS per group in closed form, rescaled to sum 1."""
    return f"""ns AS (SELECT {by}, sum(p1 * p1) AS a11, sum(p1 * p2) AS a12, sum(p2 * p2) AS a22, sum(p1 * y) AS b1, sum(p2 * y) AS b2 FROM k JOIN {src} m ON {cond} WHERE {where} GROUP BY {by}),
nu AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS u1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS u2 FROM ns),
nv AS (SELECT *, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN b1 * b1 / a11 >= b2 * b2 / a22 THEN greatest(b1 / a11, 0) ELSE 0 END AS v1,
 CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN b1 * b1 / a11 >= b2 * b2 / a22 THEN 0 ELSE greatest(b2 / a22, 0) END AS v2 FROM nu),
w AS (SELECT *, CASE WHEN v1 + v2 > 0 THEN v1 / (v1 + v2) ELSE 0.5 END AS w1, CASE WHEN v1 + v2 > 0 THEN v2 / (v1 + v2) ELSE 0.5 END AS w2 FROM nv)"""


@query("fit11", rounded_sql("members", "id, fold", f"""
WITH {_KF}, {nnls2('true')}
SELECT id, fold, w1 * p1 + w2 * p2 AS blend FROM members JOIN w USING (fold)""", 5))
def fit11(spark, sf):
    return rounded(BL.nested_blend(members(spark, sf), ["p1", "p2"], "y")[0].select("id", "fold", "blend"), 5)


@query("fit11_rmse", rounded_sql("members", "fold, g, n", f"""
WITH {_KF}, {nnls2('true')}
SELECT fold, g, sqrt(avg(pow(w1 * p1 + w2 * p2 - y, 2))) AS rmse, count(*) AS n FROM members JOIN w USING (fold) GROUP BY GROUPING SETS ((), (fold), (g))"""))
def fit11_rmse(spark, sf):
    d = BL.nested_blend(members(spark, sf), ["p1", "p2"], "y")[0]
    return rounded(M.rmse_by(d, "blend", "y", [[], ["fold"], ["g"]]))


@query("fit12", rounded_sql("members", "id", f"""
WITH mc AS (SELECT *, q1 > 25 AS cell FROM members), k AS (SELECT DISTINCT fold, cell FROM mc), {nnls2('true', 'k.fold, k.cell', 'mc', 'm.fold <> k.fold AND m.cell = k.cell')}
SELECT id, w1 * p1 + w2 * p2 AS blend FROM mc JOIN w USING (fold, cell)""", 5))
def fit12(spark, sf):
    m = members(spark, sf).withColumn("cell", F.col("q1") > 25)
    return rounded(BL.cell_blend(m, ["p1", "p2"], "y", "cell").select("id", "blend"), 5)


@query("fit12_share", rounded_sql("members", "id", """
SELECT id, p1 + CASE WHEN q1 > 25 THEN 0.8 ELSE 0.2 END * (p2 - p1) AS blend FROM members""", 5))
def fit12_share(spark, sf):
    m = members(spark, sf).withColumn("cell", F.col("q1") > 25)
    return rounded(BL.cell_blend(m, ["p1", "p2"], "y", "cell", "share").select("id", "blend"), 5)


@query("fit13")
def fit13(spark, sf):
    m = members(spark, sf).withColumn("lq", F.log("q1"))
    return rounded(BL.covariate_blend(m, ["p1", "p2"], "y", ["lq"], "linear", 0.1).select("id", "blend"))


_TERCILES = """
WITH lm AS (SELECT *, ln(q1) AS lq, p1 - p2 AS x, y - p2 AS r FROM members), f AS (SELECT DISTINCT fold AS k FROM lm),
c AS (SELECT k, quantile_cont(lq, 1 / 3.0) AS c1, quantile_cont(lq, 2 / 3.0) AS c2 FROM f JOIN lm ON fold <> k GROUP BY k),
a AS (SELECT k, sum(x * x) AS xx, sum(x * r) AS xr FROM f JOIN lm ON fold <> k GROUP BY k),
s AS (SELECT c.k, CASE WHEN lq >= c2 THEN 2 WHEN lq >= c1 THEN 1 ELSE 0 END AS t, sum(x * x) AS xx, sum(x * r) AS xr FROM c JOIN lm ON fold <> c.k GROUP BY 1, 2),
w AS (SELECT s.k, t, greatest(0, least(1, (s.xr + 0.1 / 3 * a.xr) / (s.xx + 0.1 / 3 * a.xx))) AS w FROM s JOIN a ON s.k = a.k)
SELECT id, w * p1 + (1 - w) * p2 AS blend FROM lm JOIN c ON fold = c.k JOIN w ON w.k = fold AND w.t = CASE WHEN lq >= c2 THEN 2 WHEN lq >= c1 THEN 1 ELSE 0 END"""


@query("fit13_tercile", rounded_sql("members", "id", _TERCILES, 6))
def fit13_tercile(spark, sf):
    m = members(spark, sf).withColumn("lq", F.log("q1"))
    return rounded(BL.covariate_blend(m, ["p1", "p2"], "y", ["lq"], "tercile", 0.1).select("id", "blend"), 6)


_CLIP = """r AS (SELECT id, {raw} AS raw FROM {src}), m1 AS (SELECT avg(raw) AS m FROM r), c AS (SELECT id, greatest(0.25, least(4, raw / m)) AS c FROM r, m1), m2 AS (SELECT avg(c) AS m FROM c)
SELECT id, c / m AS w FROM c, m2"""


@query("fit14", rounded_sql("members", "id", """
WITH l AS (SELECT regr_slope(ln(pow(y - p1, 2) + 1), ln(q1)) AS b, regr_intercept(ln(pow(y - p1, 2) + 1), ln(q1)) AS a FROM members),
""" + _CLIP.format(raw="exp(-(a + b * ln(q1)))", src="members, l")))
def fit14(spark, sf):
    m = members(spark, sf).withColumns({"r": F.col("y") - F.col("p1"), "lq": F.log("q1")})
    return rounded(BL.inverse_variance_weights(m, "r", ["lq"]).select("id", "w"))


@query("fit15", rounded_sql("members", "id", """
WITH s AS (SELECT count(*) AS a11, sum(1 / x4) AS a12, sum(1 / x4 / x4) AS a22, sum(pow(y - p1, 2)) AS b1, sum(pow(y - p1, 2) / x4) AS b2, avg(pow(y - p1, 2)) AS mr FROM members),
u AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS u1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS u2 FROM s),
v AS (SELECT *, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN b1 * b1 / a11 >= b2 * b2 / a22 THEN b1 / a11 ELSE 0 END AS c0, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN b1 * b1 / a11 >= b2 * b2 / a22 THEN 0 ELSE b2 / a22 END AS c1 FROM u),
""" + _CLIP.format(raw="1 / greatest(c0 + c1 / x4, 1e-3 * mr)", src="members, v")))
def fit15(spark, sf):
    m = members(spark, sf).withColumn("r", F.col("y") - F.col("p1"))
    return rounded(BL.additive_variance_weights(m, "r", ["x4"]).select("id", "w"))


@query("fit16")
def fit16(spark, sf):
    names = [*XS, "q1"]
    gs = G.gram(rows(spark, sf), G.design_exprs(names, "y"), ["fold"])
    picks = L.infold_columns(gs, names, 3.0, 4, 0.01)
    return rounded(L.crossfit_selected(rows(spark, sf), gs, names, picks, 3.0).select("id", "columns", "pred"))


@query("fit17")
def fit17(spark, sf):
    """Boosted trees whose prediction may only rise with x1 and x5; two seeds."""
    settings = BO.Settings(rounds=30, depth=4, rate=0.1, signs=(1, 0, 0, 0, 1))
    d, _, _ = BO.crossfit_boosting(rows(spark, sf), "y", XS, settings, (1, 2))
    return rounded(d.select("id", "fold", "pred"))


@query("fit17_importance")
def fit17_importance(spark, sf):
    """Share of the total gain by column of a forest of small trees."""
    settings = BO.Settings(rounds=15, depth=2, rate=0.1, least=20, rows=0.7, l2=5.0)
    _, share, _ = BO.crossfit_boosting(rows(spark, sf), "y", XS, settings)
    return spark.createDataFrame(share, "column string, share double")


@query("fit18")
def fit18(spark, sf):
    e = vector_views(spark, sf)
    cols = [f"c{i}" for i in range(64)]
    d = e.select("id", "fold", *[F.col("e")[i].alias(c) for i, c in enumerate(cols)])
    return rounded(L.principal_components(d, cols, 4, train_rows()).select("id", "pc0", "pc1", "pc2", "pc3"))


@query("fit19")
def fit19(spark, sf):
    return rounded(MD.density_ratio_weights(rows(spark, sf), ["x1", "q1"], F.col("g") == "clean").where("w IS NOT NULL").select("id", "w"))


def gate_rows(spark, sf):
    """Events with a class label and folds that keep a user together."""
    e = table(spark, sf, "events").where("event_type IN ('click', 'purchase')").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("src"), (F.col("event_type") == "purchase").cast("double").alias("t"),
        F.log1p("value").alias("lv"), F.hour("ts").cast("double").alias("hr"))
    return FO.group_folds(e, "src")


@query("fit20")
def fit20(spark, sf):
    d = MD.crossfit_logistic(gate_rows(spark, sf), ["lv", "hr"], "t")
    return rounded(MX.pass_share(d, "p", 0.5, "t"))


@query("fit20_auc", rounded_sql("", "n", """
WITH e AS (SELECT value, event_type = 'purchase' AS t FROM events WHERE event_type IN ('click', 'purchase')),
r AS (SELECT t, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM e)
SELECT (sum(CASE WHEN t THEN r ELSE 0 END) - count(CASE WHEN t THEN 1 END) * (count(CASE WHEN t THEN 1 END) + 1) / 2.0) / (count(CASE WHEN t THEN 1 END) * count(CASE WHEN NOT t THEN 1 END)) AS auc, count(*) AS n FROM r"""))
def fit20_auc(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('click', 'purchase')").select("value", (F.col("event_type") == "purchase").cast("int").alias("t"))
    return rounded(MD.auc(e, "value", "t"))


@query("fit21")
def fit21(spark, sf):
    b = F.least(F.greatest(F.floor(F.col("grey") / 0.1), F.lit(0)), F.lit(63)).cast("int")
    return rounded(MX.entity_mixture(regions(spark, sf).select("img", "grey"), b, 0.0, 0.1, 64, 0.08, 0.9))


@query("fit22")
def fit22(spark, sf):
    r = rows(spark, sf)
    k = SP.spline_knots(r.where(train_rows()), ["q1"])["q1"]
    return rounded(r.select("id", *[b.alias(f"b{i}") for i, b in enumerate(SP.spline_basis("q1", k, last=True))]))


@query("fit22_tensor")
def fit22_tensor(spark, sf):
    r = rows(spark, sf)
    k = SP.spline_knots(r.where(train_rows()), ["q1"])["q1"]
    return rounded(r.select("id", *[b.alias(f"t{i}") for i, b in enumerate(SP.tensor_products(SP.spline_basis("q1", k), F.col("x2")))]))


def unit_weight():
    return F.greatest("ctx", F.lit(0.05))


@query("fit23")
def fit23(spark, sf):
    b = blocks(spark, sf)
    k = SP.spline_knots(b, ["meas"])
    plain = SP.pooled_basis(b, "id", k, unit_weight())
    control = SP.pooled_basis(b, "id", k, unit_weight(), jensen=True)
    return rounded(plain.join(control.withColumnsRenamed({c: f"j_{c}" for c in control.columns if c != "id"}), "id"))


@query("fit24")
def fit24(spark, sf):
    """Blocks carry their entity's target; block predictions of the other folds are pooled per entity."""
    e = vector_views(spark, sf).select("id", "y", "fold")
    u = blocks(spark, sf).join(e, "id")
    d, _ = L.crossfit_ridge(u, "y", ["meas", "ctx"], ALPHAS)
    return rounded(B.pooled_predictions(d, "pred", unit_weight()))


@query("fit24_nested", rounded_sql("", "id, outer_fold", """
WITH e AS (SELECT vec_id AS id, CAST(label AS DOUBLE) AS y, CAST((dense_rank() OVER (ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings),
px AS (SELECT vec_id AS id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
b AS (SELECT id, y // 2 AS by_, x // 2 AS bx, avg(v) AS meas, max(v) AS ctx FROM px GROUP BY ALL), u AS (SELECT b.*, e.y AS target, fold FROM b JOIN e USING (id)),
k AS (SELECT a.fold AS o, c.fold AS j FROM (SELECT DISTINCT fold FROM e) a, (SELECT DISTINCT fold FROM e) c),
s AS (SELECT o, j, regr_slope(target, meas) AS c1, regr_intercept(target, meas) AS c0 FROM k JOIN u ON u.fold <> o AND u.fold <> j GROUP BY o, j),
p AS (SELECT id, o, c0 + c1 * meas AS pred, greatest(ctx, 0.05) AS w FROM u JOIN s ON s.j = u.fold)
SELECT id, o AS outer_fold, avg(pred) AS mil_mean, sum(w * pred) / sum(w) AS mil_wmean FROM p GROUP BY id, o"""))
def fit24_nested(spark, sf):
    """Inner and outer block predictions pooled per entity under every outer fold, for stacking."""
    e = vector_views(spark, sf).select("id", "y", "fold")
    d = L.nested_predictions(blocks(spark, sf).join(e, "id"), "y", ["meas"], [0.0])
    d = d.groupBy("id", F.col("outer").alias("outer_fold")).agg(F.avg("pred").alias("mil_mean"), (F.sum(unit_weight() * F.col("pred")) / F.sum(unit_weight())).alias("mil_wmean"))
    return rounded(d)


@query("fit25")
def fit25(spark, sf):
    return rounded(SP.random_features(blocks(spark, sf), "id", ["meas", "ctx"], unit_weight(), 8, 0.2))


@query("fit26")
def fit26(spark, sf):
    """Variants are degraded copies of their image; the clean value is the label of the source."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("clean"))
    v = variants(spark, sf).withColumn("m2", F.col("meas") * F.col("meas"))
    pairs = v.where("var > 0").join(e, "id").withColumnRenamed("id", "src")
    return rounded(MD.calibrate(pairs, ["meas", "m2"], "clean", "src", v.where("var = 0"), ALPHAS, "id").select("id", "cal"))


@query("fit27")
def fit27(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("clean"))
    v = variants(spark, sf)
    pairs = v.where("var > 0").join(e, "id").withColumnRenamed("id", "src")
    return rounded(MD.calibrate_banded(pairs, ["meas"], "clean", "src", "meas", [-0.01, 0.01], 0.01, v.where("var = 0"), 1.0, "id").select("id", "cal"))


@query("fit28", rounded_sql("members", "fold", """
SELECT fold, sum(0.5 * (ln(2 * pi() * (400 + 900 / x4)) + pow(y - p1, 2) / (400 + 900 / x4))) AS nll FROM members GROUP BY fold""", 4))
def fit28(spark, sf):
    m = members(spark, sf)
    n = V.gaussian_nll(F.col("y") - F.col("p1"), [F.lit(1.0), 1 / F.col("x4")], [400.0, 900.0])
    return rounded(m.groupBy("fold").agg(F.sum(n).alias("nll")), 4)


@query("fit28_gain")
def fit28_gain(spark, sf):
    m = members(spark, sf).withColumn("r", F.col("y") - F.col("p1"))
    return rounded(V.nll_gain(m, "r", [F.lit(1.0)], [F.col("x1") / 100]), 4)


FORMS = {
    "line": (lambda p: p[0] + p[1] * F.col("x1"), [0.0, 1.0]),
    "power": (lambda p: p[0] * F.pow(F.col("x1"), p[1]), [1.5, 1.0]),
    "mix": (lambda p: (p[0] * F.col("x1") + p[1] * F.col("x4")) * F.exp(-p[2] * F.col("x2")), [1.0, 1.0, 0.0]),
}


@query("fit29")
def fit29(spark, sf):
    form, start = FORMS["mix"]
    return rounded(V.crossfit_nonlinear(rows(spark, sf), "y", form, start, steps=6)[0].select("id", "pred"), 4)


@query("fit30")
def fit30(spark, sf):
    d = L.residual_probe(rows(spark, sf), "y", ["x1", "x4"], ["x2", "q1"], ALPHAS, apply=F.col("g") != "HLV")
    return rounded(d.select("id", "base_pred", "probe"))


@query("fit31", rounded_sql("rows_", "bin", f"""
WITH q AS (SELECT quantile_cont(q1, 1 / 3.0) AS a, quantile_cont(q1, 2 / 3.0) AS b FROM rows_),
t AS (SELECT id, y, x1, x4, CASE WHEN q1 >= b THEN 2 WHEN q1 >= a THEN 1 ELSE 0 END AS bin FROM rows_, q),
many AS (SELECT * FROM t, (SELECT unnest(range(0, 41)) AS rep)), hs AS ({mixed_sql('many', 'rep', 'id')}), ws AS (SELECT *, CASE WHEN rep = 0 THEN 1e0 ELSE {poisson_weight_sql('h')} END AS w FROM hs),
m AS (SELECT rep, bin, sum(w) AS n, sum(w * x1) AS s1, sum(w * x4) AS s4, sum(w * y) AS sy, sum(w * x1 * x1) AS s11, sum(w * x1 * x4) AS s14, sum(w * x4 * x4) AS s44, sum(w * x1 * y) AS s1y, sum(w * x4 * y) AS s4y FROM ws GROUP BY rep, bin),
c AS (SELECT rep, bin, ((s1y - s1 * sy / n) * (s44 - s4 * s4 / n) - (s4y - s4 * sy / n) * (s14 - s1 * s4 / n)) / ((s11 - s1 * s1 / n) * (s44 - s4 * s4 / n) - (s14 - s1 * s4 / n) ** 2) AS slope FROM m),
r AS (SELECT c.rep, c.bin, c.slope, c.slope / l.slope AS ratio FROM c JOIN c l ON l.rep = c.rep AND l.bin = 2)
SELECT bin, max(slope) FILTER (WHERE rep = 0) AS slope, max(ratio) FILTER (WHERE rep = 0) AS ratio, quantile_cont(ratio, 0.05) FILTER (WHERE rep > 0) AS lo, quantile_cont(ratio, 0.95) FILTER (WHERE rep > 0) AS hi FROM r GROUP BY bin""", 5))
def fit31(spark, sf):
    r = rows(spark, sf)
    d = r.withColumn("tb", M.tercile(r, "q1"))
    return rounded(L.attenuation_slopes(d, "x1", "y", ["x4"], "tb", 40), 5)


_PC = "sqrt((1 - pow(corr(x1, x4), 2)) * (1 - pow(corr(y, x4), 2)))"


@query("fit32", rounded_sql("rows_", "g", f"""
SELECT g, (corr(x1, y) - corr(x1, x4) * corr(y, x4)) / {_PC} AS pcorr,
 (covar_pop(x1, y) - covar_pop(x1, x4) * covar_pop(y, x4) / var_pop(x4)) / (var_pop(x1) - pow(covar_pop(x1, x4), 2) / var_pop(x4)) AS pslope,
 sqrt((var_pop(y) - pow(covar_pop(y, x4), 2) / var_pop(x4)) / (var_pop(x1) - pow(covar_pop(x1, x4), 2) / var_pop(x4))) AS sd_ratio FROM rows_ GROUP BY g"""))
def fit32(spark, sf):
    return rounded(L.partial_stats(rows(spark, sf), "x1", "y", "x4", ["g"]))


@query("fit33", rounded_sql("rows_", "id, outside", """
WITH m AS (SELECT avg(x1) AS ma, avg(q1) AS mb, var_samp(x1) AS va, var_samp(q1) AS vb, covar_samp(x1, q1) AS c FROM rows_ WHERE g = 'clean'),
d AS (SELECT id, g, sqrt((pow(x1 - ma, 2) * vb - 2 * (x1 - ma) * (q1 - mb) * c + pow(q1 - mb, 2) * va) / (va * vb - c * c)) AS dist FROM rows_, m),
t AS (SELECT quantile_cont(dist, 0.99) AS t FROM d WHERE g = 'clean')
SELECT id, dist, dist > t + 1e-9 AS outside FROM d, t"""))
def fit33(spark, sf):
    from ..functions.ranks import global_quantiles

    r = rows(spark, sf)
    clean = F.col("g") == "clean"
    d = L.mahalanobis(r, "x1", "q1", clean)
    cut = global_quantiles(d.where(clean), "dist", [0.99])[0]
    return rounded(d.select("id", "dist", (F.col("dist") > cut + 1e-9).alias("outside")))


@query("fit34", with_ctes("files", """
WITH d AS (SELECT x2, f1 - f0 AS d1, f2 - f0 AS d2, f3 - f0 AS d3 FROM files),
l AS (SELECT i, j, count(*) AS n, sum(a * a * b * b) AS s2, sum(a * a) AS sa, sum(b * b) AS sb, sum(a * b * x2) AS w FROM (
 SELECT x2, unnest(['f1', 'f2', 'f3']) AS i, unnest([d1, d2, d3]) AS a, d1, d2, d3 FROM d) p, LATERAL (SELECT unnest(['f1', 'f2', 'f3']) AS j, unnest([d1, d2, d3]) AS b) q GROUP BY i, j)
SELECT i, j, round((0.3 * 0.7 * n / (n - 1e0) * (s2 - sa * sb / n) + 4 * 0.3 * w) / pow(0.3 * n, 2), 6) AS k FROM l"""))
def fit34(spark, sf):
    return rounded(INF.covariance_rows(files(spark, sf), "f0", ["f1", "f2", "f3"], "x2", 0.3))


@query("fit34_loo")
def fit34_loo(spark, sf):
    f = files(spark, sf)
    names = ["f1", "f2", "f3"]
    k = INF.reading_covariance(*INF.change_sums(f, "f0", names, "x2"), 0.3, 1e-6)
    a = f.agg(*[(F.avg(F.pow(F.col(n) - F.col("y"), 2)) - F.avg(F.pow(F.col("f0") - F.col("y"), 2)) - F.avg(F.pow(F.col(n) - F.col("f0"), 2))).alias(n) for n in names]).first()
    import numpy as np

    loo = INF.leave_one_reading_out(k, np.array([a[n] for n in names]))
    return rounded(spark.createDataFrame([(n, *v) for n, v in zip(names, loo)], "file string, pred double, sd double, z double"))


@query("fit35")
def fit35(spark, sf):
    f = files(spark, sf)
    mse = f.agg(*[F.avg(F.pow(F.col(n) - F.col("y"), 2)).alias(n) for n in ("f0", "f1", "f2")]).first()
    return rounded(INF.predict_candidates(f, "f0", ["f1", "f2"], [mse["f1"] - mse["f0"], mse["f2"] - mse["f0"]], ["f3"], "x2", 0.3, mse["f2"] - mse["f0"], 1e-6))


@query("fit36", rounded_sql("blocks", "", """
WITH g AS (SELECT id, avg(ctx) AS mp, avg(meas) AS mt, stddev_pop(ctx) AS hp, stddev_pop(meas) AS ht, max(meas) AS s FROM blocks GROUP BY id)
SELECT (SELECT corr(ctx, meas) FROM blocks) AS corr_block, (SELECT corr(ctx - mp, meas - mt) FROM blocks JOIN g USING (id)) AS corr_block_within,
 corr(hp, ht) AS corr_het, avg(hp) AS het_hat_mean, avg(ht) AS het_mean,
 (corr(hp, ht) - corr(hp, s) * corr(ht, s)) / sqrt((1 - pow(corr(hp, s), 2)) * (1 - pow(corr(ht, s), 2))) AS pcorr_het,
 (covar_pop(hp, ht) - covar_pop(hp, s) * covar_pop(ht, s) / var_pop(s)) / (var_pop(hp) - pow(covar_pop(hp, s), 2) / var_pop(s)) AS slope_het,
 sqrt((var_pop(ht) - pow(covar_pop(ht, s), 2) / var_pop(s)) / (var_pop(hp) - pow(covar_pop(hp, s), 2) / var_pop(s))) AS sdratio_het FROM g"""))
def fit36(spark, sf):
    return rounded(L.reader_metrics(blocks(spark, sf).withColumn("s", F.col("meas")), "ctx", "meas", "s"))


@query("fit37")
def fit37(spark, sf):
    e = seq(spark, sf).withColumn("z", F.log1p("value"))
    s = MX.mixture_share(e, "z", e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), 0.0, 7.0, 0.3)
    return rounded(spark.createDataFrame([(s["share"], s["q05"], s["q50"], s["q95"])], "share double, q05 double, q50 double, q95 double"))


@query("fit38")
def fit38(spark, sf):
    d = MX.surface_and_phase(regions(spark, sf).withColumn("grey", F.least(F.col("grey"), F.lit(3.0))))
    return rounded(d.groupBy("img").agg(F.max("thr").alias("thr"), F.avg(F.col("keep").cast("double")).alias("bright")))


@query("ras22")
def ras22(spark, sf):
    d = MX.shading_ratio(regions(spark, sf).withColumn("grey", F.least(F.col("grey"), F.lit(3.0))))
    return rounded(d.groupBy("img").agg(F.avg("ratio").alias("ratio_mean"), F.avg(F.col("keep").cast("double")).alias("kept")))


@query("fun02_probability", rounded_sql("members", "g", """
WITH s AS (SELECT g, avg(y - p1) / (stddev_pop(y - p1) / sqrt(count(*))) AS z FROM members GROUP BY g),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM s), u AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t AS u FROM t)
SELECT g, z, CASE WHEN z >= 0 THEN 1 - u ELSE u END AS p FROM u""", 5))
def fun02_probability(spark, sf):
    r = F.col("y") - F.col("p1")
    s = members(spark, sf).groupBy("g").agg((F.avg(r) / (F.stddev_pop(r) / F.sqrt(F.count(r)))).alias("z"))
    return rounded(s.withColumn("p", norm_cdf("z")), 5)
