"""Metric and profile queries."""

from pyspark.sql import functions as F

from ..functions.ranks import weighted_quantiles
from ..operators import metrics as M
from .fixtures import train_rows, files, members, regions, rounded, rounded_sql, rows, samples, seq, table, variants, with_ctes
from .registry import query

Q3 = "(SELECT quantile_cont({c}, {p}) FROM {t}{w})"


def q3(c, k, t="rows_", w=""):
    return Q3.format(c=c, p=f"{k}/3", t=t, w=w)


@query("agg01", rounded_sql("members", "fold, n", """
SELECT fold, sqrt(avg((p1 - y) ** 2)) AS rmse, count(*) AS n FROM members GROUP BY ROLLUP (fold)"""))
def agg01(spark, sf):
    return rounded(M.rmse_by(members(spark, sf), "p1", "y", [["fold"], []]))


@query("agg02", rounded_sql("members", "bin, n", f"""
SELECT CAST((q1 >= {q3('q1', 1, w=' WHERE fold <> 4')})::INT + (q1 >= {q3('q1', 2, w=' WHERE fold <> 4')})::INT AS INTEGER) AS bin,
 sqrt(avg((p1 - y) ** 2)) AS rmse, count(*) AS n FROM members GROUP BY 1"""))
def agg02(spark, sf):
    m = members(spark, sf)
    d = m.withColumn("bin", M.tercile(m, "q1", train_rows()))
    return rounded(d.groupBy("bin").agg(M.rmse("p1", "y").alias("rmse"), F.count(F.lit(1)).alias("n")))


@query("agg03", rounded_sql("members", "in_cell, fold, n", """
SELECT q1 > 25 AND x4 > 4 AS in_cell, fold, sqrt(avg((p1 - y) ** 2)) AS rmse, count(*) AS n FROM members GROUP BY CUBE (1, 2)"""))
def agg03(spark, sf):
    d = members(spark, sf).withColumn("in_cell", (F.col("q1") > 25) & (F.col("x4") > 4))
    return rounded(M.rmse_by(d, "p1", "y", [["in_cell", "fold"], ["in_cell"], ["fold"], []]))


@query("agg04", rounded_sql("members", "bin, n", f"""
WITH b AS (SELECT * EXCLUDE (bin), CAST((q1 > {q3('q1', 1, 'members')})::INT + (q1 > {q3('q1', 2, 'members')})::INT AS INTEGER) AS bin FROM members)
SELECT bin, count(*) AS n, median(q1) AS med, sqrt(avg((p1 - y) ** 2)) AS rmse, stddev_samp(y) AS y_sd, stddev_samp(p1) AS pred_sd,
 avg(y) AS y_mean, avg(y - p1) AS resid_mean, corr(p1, y) AS corr FROM b GROUP BY bin"""))
def agg04(spark, sf):
    m = members(spark, sf)
    d = m.withColumn("bin", M.quantile_bin(m, "q1", 3))
    return rounded(M.profile(d, ["bin"], "p1", "y", "q1"))


@query("agg05", rounded_sql("rows_", "g, n", """
SELECT g, count(*) AS n, avg(y) AS mean_y, avg(x1) AS mean_x1, median(x2) AS med_x2, median(x3) AS med_x3 FROM rows_ GROUP BY g"""))
def agg05(spark, sf):
    return rounded(M.band_summary(rows(spark, sf), ["g"], ["y", "x1"], ["x2", "x3"]))


@query("agg06", rounded_sql("regions", "img", """
SELECT img, sum(area * grey) / sum(area) AS wmean, sqrt(sum(area * grey * grey) / sum(area)) AS wrms,
 sqrt(greatest(0, sum(area * grey * grey) / sum(area) - pow(sum(area * grey) / sum(area), 2))) AS wsd FROM regions GROUP BY img""", 5))
def agg06(spark, sf):
    g = regions(spark, sf).groupBy("img").agg(M.wmean("grey", "area").alias("wmean"), M.wrms("grey", "area").alias("wrms"), M.wsd("grey", "area").alias("wsd"))
    return rounded(g, 5)


@query("agg07", rounded_sql("regions", "img", """
WITH o AS (SELECT img, grey, area, sum(area) OVER (PARTITION BY img ORDER BY grey, area ROWS UNBOUNDED PRECEDING) / sum(area) OVER (PARTITION BY img) AS c FROM regions),
l AS (SELECT *, lag(c) OVER w AS c0, lag(grey) OVER w AS g0 FROM o WINDOW w AS (PARTITION BY img ORDER BY c)),
q AS (SELECT img, q, arg_min(coalesce(g0 + (q - c0) / (c - c0) * (grey - g0), grey), c) AS v FROM l, (SELECT unnest([0.25, 0.75]) AS q) WHERE c >= q GROUP BY img, q)
SELECT img, max(CASE WHEN q < 0.5 THEN v END) AS w25, max(CASE WHEN q > 0.5 THEN v END) AS w75 FROM q GROUP BY img"""))
def agg07(spark, sf):
    return rounded(weighted_quantiles(regions(spark, sf), ["img"], "grey", "area", {"w25": 0.25, "w75": 0.75}))


@query("agg39", """
SELECT CAST(d AS INTEGER) AS digits, max(n) AS max_n, count(*) AS n_distinct FROM (
 SELECT d, CASE WHEN d = 0 THEN round(value, 0) ELSE round(value, 1) END AS v, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY 1, 2) GROUP BY d""")
def agg39(spark, sf):
    return M.multiplicity(seq(spark, sf), "value", [0, 1])


@query("agg40", """
SELECT CAST(d AS DOUBLE) AS spacing, round(sqrt(avg(cos(2 * pi() * value / d)) ** 2 + avg(sin(2 * pi() * value / d)) ** 2), 6) AS power
FROM events, (SELECT unnest([0.5, 1, 2, 2.5, 5, 10]) AS d) GROUP BY d""")
def agg40(spark, sf):
    return rounded(M.lattice_power(seq(spark, sf), "value", [0.5, 1.0, 2.0, 2.5, 5.0, 10.0]))


@query("agg41", """
WITH d AS (SELECT CAST(i AS INTEGER) AS i, CAST(i * 5 AS DOUBLE) AS x, sum(exp(-pow((i * 5 - value) / 8, 2) / 2)) / (8 * sqrt(2 * pi())) / count(*) AS dens
 FROM events, (SELECT unnest(range(0, 80)) AS i) GROUP BY i)
SELECT i, x, round(dens, 9) AS dens, coalesce(dens > lag(dens) OVER (ORDER BY i) AND dens > lead(dens) OVER (ORDER BY i), false) AS peak FROM d""")
def agg41(spark, sf):
    return M.kde(seq(spark, sf), [], "value", [5.0 * i for i in range(80)], 8.0).withColumn("dens", F.round("dens", 9))


@query("agg42", rounded_sql("rows_", "g", "SELECT g, pow(sum(y), 2) / sum(y * y) AS ess FROM rows_ GROUP BY g"))
def agg42(spark, sf):
    return rounded(rows(spark, sf).groupBy("g").agg(M.effective_size("y").alias("ess")))


@query("agg43", rounded_sql("rows_", "g, train_pass, train_n, test_pass, test_n", """
SELECT g, count(CASE WHEN fold <> 4 AND x3 > 0.04 THEN 1 END) AS train_pass, count(CASE WHEN fold <> 4 THEN 1 END) AS train_n,
 count(CASE WHEN fold = 4 AND x3 > 0.04 THEN 1 END) AS test_pass, count(CASE WHEN fold = 4 THEN 1 END) AS test_n,
 count(CASE WHEN fold <> 4 AND x3 > 0.04 THEN 1 END) / count(CASE WHEN fold <> 4 THEN 1 END) AS train_rate,
 count(CASE WHEN fold = 4 AND x3 > 0.04 THEN 1 END) / count(CASE WHEN fold = 4 THEN 1 END) AS test_rate FROM rows_ GROUP BY g"""))
def agg43(spark, sf):
    return rounded(M.gate_counts(rows(spark, sf), "g", F.col("fold") == 4, F.col("x3") > 0.04))


@query("agg43_p", rounded_sql("rows_", "g", """
WITH t AS (SELECT g, count(CASE WHEN fold <> 4 AND x3 > 0.04 THEN 1 END) AS a, count(CASE WHEN fold <> 4 THEN 1 END) AS r1,
 count(CASE WHEN fold = 4 THEN 1 END) AS r2, count(CASE WHEN x3 > 0.04 THEN 1 END) AS c1 FROM rows_ GROUP BY g),
k AS (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS k FROM t),
p AS (SELECT g, a, k, lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1) - lgamma(r1 + r2 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1) AS lp FROM k)
SELECT g, least(1e0, sum(exp(lp))) AS fisher_p FROM p JOIN (SELECT g, lp AS seen FROM p WHERE k = a) USING (g) WHERE lp <= seen + 1e-7 GROUP BY g"""))
def agg43_p(spark, sf):
    c = M.gate_counts(rows(spark, sf), "g", F.col("fold") == 4, F.col("x3") > 0.04)
    tr, te = F.col("train_n") - F.col("train_pass"), F.col("test_n") - F.col("test_pass")
    return rounded(c.select("g", M.fisher_p("train_pass", tr, "test_pass", te).alias("fisher_p")))


@query("agg44", with_ctes("rows_", """
SELECT count(*) AS n, round(sum(round(x2, 5)), 4) AS sum_x2, round(sum(round(x1n, 5)), 4) AS sum_x1n,
 CAST(sum(CASE WHEN x2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_x2, CAST(sum(CASE WHEN x1n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_x1n FROM rows_"""))
def agg44(spark, sf):
    return rounded(M.checksums(rows(spark, sf), ["x2", "x1n"], 5), 4)


@query("agg45", with_ctes("files", "SELECT id, round((f0 + f1 + f2) / 3, 6) AS pred, CAST(3 AS BIGINT) AS n_readers FROM files"))
def agg45(spark, sf):
    f = files(spark, sf)
    return rounded(M.average_readers([f.select("id", F.col(c).alias("pred")) for c in ("f0", "f1", "f2")], "id", "pred"))


@query("agg46", with_ctes("rows_", """
WITH m AS (SELECT k AS mf, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM rows_, (SELECT unnest(range(0, 5)) AS k) WHERE fold <> k GROUP BY k),
p AS (SELECT r.id, CASE WHEN fold <> 4 THEN fold END AS own, mf, a + b * x1 AS pred FROM rows_ r, m)
SELECT id, round(CASE WHEN own IS NOT NULL THEN max(CASE WHEN own = mf THEN pred END) ELSE avg(pred) END, 6) AS pred,
 CASE WHEN own IS NULL THEN 'mean5' ELSE 'oof' || own END AS src FROM p GROUP BY id, own"""))
def agg46(spark, sf):
    """Training rows take the model that has not seen them, the unlabelled part the mean of all five."""
    from ..functions.scalar import linear
    from ..operators.gram import design_exprs, gram, leave_out, solve

    r = rows(spark, sf)
    fits = {k[0]: solve(g) for k, g in leave_out(gram(r, design_exprs(["x1"], "y"), ["fold"])).items()}
    models = F.array(*[F.struct(F.lit(k).alias("mf"), linear(fits[k][1:], ["x1"], fits[k][0]).alias("pred")) for k in sorted(fits)])
    own = r.select("id", F.when(train_rows(), F.col("fold")).alias("fold"))
    return rounded(M.combine_folds(r.select("id", F.inline(models)), own, "id", "mf", "pred"))


@query("agg47", rounded_sql("rows_", "feature", """
WITH l AS (UNPIVOT (SELECT fold = 4 AS t, x1, x2, q1 FROM rows_) ON x1, x2, q1 INTO NAME feature VALUE value)
SELECT feature, median(CASE WHEN NOT t THEN value END) AS train_med, median(CASE WHEN t THEN value END) AS test_med,
 (avg(CASE WHEN t THEN value END) - avg(CASE WHEN NOT t THEN value END)) / stddev_samp(CASE WHEN NOT t THEN value END) AS smd FROM l GROUP BY feature"""))
def agg47(spark, sf):
    return rounded(M.shift_profile(rows(spark, sf), ["x1", "x2", "q1"], ~train_rows()))


_W = " WHERE fold <> 4"


@query("agg48", rounded_sql("rows_", "feature, is_test, bin", f"""
WITH l AS (SELECT fold = 4 AS is_test, 'x1' AS feature, CAST((x1 >= {q3('x1', 1, w=_W)})::INT + (x1 >= {q3('x1', 2, w=_W)})::INT AS INTEGER) AS bin FROM rows_
 UNION ALL SELECT fold = 4, 'q1', CAST((q1 >= {q3('q1', 1, w=_W)})::INT + (q1 >= {q3('q1', 2, w=_W)})::INT AS INTEGER) FROM rows_)
SELECT feature, is_test, bin, n / sum(n) OVER (PARTITION BY feature, is_test) AS share FROM (SELECT feature, is_test, bin, count(*) AS n FROM l GROUP BY feature, is_test, bin)"""))
def agg48(spark, sf):
    return rounded(M.bin_shares(rows(spark, sf), ["x1", "q1"], ~train_rows()))


@query("agg49", rounded_sql("variants", "id", "SELECT id, stddev_pop(meas) AS sd, max(meas) - min(meas) AS rng, avg(meas) AS mean FROM variants GROUP BY id"))
def agg49(spark, sf):
    return rounded(M.variant_stability(variants(spark, sf), "id", "meas"))


@query("agg57", rounded_sql("variants", "id", """
SELECT id, avg(CASE WHEN var <= 1 THEN meas END) - avg(CASE WHEN var >= 3 THEN meas END) AS contrast FROM variants GROUP BY id"""))
def agg57(spark, sf):
    return rounded(M.variant_contrast(variants(spark, sf), "id", "var", "meas", [0, 1], [3, 4]))
