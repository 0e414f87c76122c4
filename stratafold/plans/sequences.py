"""Window, ranking and sequence queries."""

from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators import ranking as K
from .fixtures import blocks, files, labelmap, mask, members, regions, rounded, rounded_sql, rows, seq, table, with_ctes
from .rasters import _runs_sql
from .registry import query

_RANK = """
rk AS (SELECT feature, value, y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM lg)"""


@query("win04", rounded_sql("rows_", "feature, n", f"""
WITH lg AS (UNPIVOT (SELECT y, x1, x2, x3, x4, x5, q1 FROM rows_) ON x1, x2, x3, x4, x5, q1 INTO NAME feature VALUE value), {_RANK}
SELECT feature, corr(rx, ry) AS rho, count(*) AS n FROM rk GROUP BY feature ORDER BY abs(corr(rx, ry)) DESC LIMIT 3"""))
def win04(spark, sf):
    s = K.spearman(rows(spark, sf), ["x1", "x2", "x3", "x4", "x5", "q1"], "y")
    return rounded(K.top_by_abs(s, "rho", 3, "feature"))


@query("win05", rounded_sql("members", "feature", """
WITH lg AS (UNPIVOT (SELECT y, y - p1 AS res, g, x1, x2, q1 FROM members) ON x1, x2, q1 INTO NAME feature VALUE value),
a AS (SELECT *, 'all' AS k FROM lg UNION ALL SELECT *, 'clean' FROM lg WHERE g = 'clean'),
r AS (SELECT feature, k, rank() OVER (PARTITION BY k, feature ORDER BY value) + (count(*) OVER (PARTITION BY k, feature, value) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY k, feature ORDER BY y) + (count(*) OVER (PARTITION BY k, feature, y) - 1) / 2.0 AS ry,
 rank() OVER (PARTITION BY k, feature ORDER BY round(res, 9)) + (count(*) OVER (PARTITION BY k, feature, round(res, 9)) - 1) / 2.0 AS rr FROM a)
SELECT feature, corr(rx, ry) FILTER (WHERE k = 'all') AS rho_y, corr(rx, ry) FILTER (WHERE k = 'clean') AS rho_y_clean, corr(rx, rr) FILTER (WHERE k = 'all') AS rho_resid FROM r GROUP BY feature"""))
def win05(spark, sf):
    m = members(spark, sf).withColumn("res", F.round(F.col("y") - F.col("p1"), 9))
    g = K.spearman_grid(m, ["x1", "x2", "q1"], ["y", "res"], {"all": F.lit(True), "clean": F.col("g") == "clean"})
    cell = lambda k, t: F.max(F.when((F.col("subset") == k) & (F.col("target") == t), F.col("rho")))
    return rounded(g.groupBy("feature").agg(cell("all", "y").alias("rho_y"), cell("clean", "y").alias("rho_y_clean"), cell("all", "res").alias("rho_resid")))


@query("win06", rounded_sql("seq", "lag, n", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY id) AS rn FROM seq)
SELECT CAST(k AS INTEGER) AS lag, corr(a.value, b.value) AS ac, count(*) AS n FROM (SELECT unnest([1, 2, 3, 5, 10]) AS k), r a JOIN r b ON b.rn = a.rn + k GROUP BY k"""))
def win06(spark, sf):
    return rounded(K.lag_correlation(seq(spark, sf), "id", "value", [1, 2, 3, 5, 10]))


@query("win07", "SELECT k AS id FROM (SELECT unnest(range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem))) AS k) WHERE k NOT IN (SELECT l_orderkey FROM lineitem)")
def win07(spark, sf):
    return K.missing_keys(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), "id")


@query("win08", with_ctes("mask", f"SELECT img, line, len, count(*) AS n FROM ({_runs_sql('x', 'y')}) WHERE m AND NOT open GROUP BY 1, 2, 3"))
def win08(spark, sf):
    r = R.runs(mask(spark, sf), F.col("m")).where("m AND NOT open")
    return r.groupBy("img", "line", "len").agg(F.count(F.lit(1)).alias("n"))


@query("win09", rounded_sql("mask", "img", """
WITH n AS (SELECT a.img, count(*) FILTER (WHERE b.y = a.y AND b.x = a.x - 1) AS l, count(*) FILTER (WHERE b.y = a.y - 1 AND b.x = a.x) AS u,
 count(*) FILTER (WHERE b.y = a.y - 1 AND b.x = a.x - 1) AS ul, count(*) FILTER (WHERE b.y = a.y - 1 AND b.x = a.x + 1) AS ur
 FROM mask a JOIN mask b ON a.img = b.img AND a.m AND NOT b.m GROUP BY a.img),
i AS (SELECT m.img, 64.0 / greatest(coalesce(l, 0), 1) AS a, 49 * sqrt(2) / greatest(coalesce(ur, 0), 1) AS b, 64.0 / greatest(coalesce(u, 0), 1) AS c, 49 * sqrt(2) / greatest(coalesce(ul, 0), 1) AS d
 FROM (SELECT DISTINCT img FROM mask) m LEFT JOIN n USING (img))
SELECT img, (a + b + c + d) / 4 AS L_mean, greatest(a, b, c, d) AS L_max, least(a, b, c, d) AS L_min, greatest(a, b, c, d) / least(a, b, c, d) AS L_aniso, 1 / sqrt((a + b + c + d) / 4) AS L_inv_sqrt FROM i"""))
def win09(spark, sf):
    return rounded(R.intercepts(mask(spark, sf), F.col("m"), 8))


_PCS = """pcs AS (SELECT img, y AS line, 'x' AS axis, CAST(1 + sum(c) AS BIGINT) AS pieces FROM (SELECT img, y, CASE WHEN lab <> lag(lab) OVER (PARTITION BY img, y ORDER BY x) THEN 1 ELSE 0 END AS c FROM labelmap) GROUP BY img, y
UNION ALL SELECT img, x, 'y', CAST(1 + sum(c) AS BIGINT) FROM (SELECT img, x, CASE WHEN lab <> lag(lab) OVER (PARTITION BY img, x ORDER BY y) THEN 1 ELSE 0 END AS c FROM labelmap) GROUP BY img, x)"""


@query("win10", with_ctes("labelmap", f"WITH {_PCS}\nSELECT img, line, axis, pieces FROM pcs"))
def win10(spark, sf):
    lm = labelmap(spark, sf)
    return R.pieces_per_line(lm, "lab", "x").unionByName(R.pieces_per_line(lm, "lab", "y"))


@query("win11", rounded_sql("labelmap", "img", f"WITH {_PCS}\nSELECT img, " + ", ".join(
    f"avg(pieces) FILTER (WHERE least(line, 7 - line) = {k}) / avg(pieces) AS ring{k}" for k in range(3)) + " FROM pcs GROUP BY img"))
def win11(spark, sf):
    return rounded(R.edge_ring_profile(labelmap(spark, sf), "lab", 3, 8))


@query("win12", with_ctes("regions", """
SELECT img, min(grey) AS wmed FROM (SELECT img, grey, sum(area) OVER (PARTITION BY img ORDER BY grey) AS c, sum(area) OVER (PARTITION BY img) AS t FROM regions) WHERE c >= 0.5 * t GROUP BY img"""))
def win12(spark, sf):
    return K.median_by_weight(regions(spark, sf), ["img"], "grey", "area")


@query("win13", rounded_sql("members", "qbin, size", """
WITH e AS (SELECT quantile_cont(q1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM members),
b AS (SELECT CAST(len(list_filter(list_distinct(e), lambda z: z < q1)) AS INTEGER) AS qbin, q1, (y - p1) ** 2 AS r2 FROM members, e)
SELECT qbin, avg(q1) AS x_mean, avg(r2) AS r2_mean, stddev_samp(r2) / sqrt(count(*)) AS r2_sem, count(*) AS size FROM b GROUP BY qbin"""))
def win13(spark, sf):
    return rounded(K.binned_squares(members(spark, sf).withColumn("r", F.col("y") - F.col("p1")), "q1", "r", 10))


_D4 = K.dihedral_maps(4)


@query("win14", rounded_sql("blocks", "id, k, blk", "WITH m(k, blk, src) AS (VALUES " + ", ".join(
    f"({k}, {j}, {s})" for k, m in _D4.items() for j, s in enumerate(m)) + ")\nSELECT id, k, m.blk, meas FROM blocks b JOIN m ON m.src = b.blk"))
def win14(spark, sf):
    return rounded(K.permute_blocks(blocks(spark, sf), _D4))


@query("win15", rounded_sql("files", "n", """
WITH d AS (SELECT id, (f3 - y) ** 2 - (f2 - y) ** 2 AS d FROM files)
SELECT avg(d) AS dmse, (SELECT avg(d) FROM (SELECT d, row_number() OVER (ORDER BY round(d, 9), id) AS rn FROM d) WHERE rn > 3) AS droptop3, count(*) AS n FROM d"""))
def win15(spark, sf):
    d = files(spark, sf).select("id", F.round(F.pow(F.col("f3") - F.col("y"), 2) - F.pow(F.col("f2") - F.col("y"), 2), 9).alias("d"))
    a = d.agg(F.avg("d").alias("dmse"), F.count(F.lit(1)).alias("n"))
    kept = K.drop_top(d, "d", 3, "id").agg(F.avg("d").alias("droptop3"))
    return rounded(a.withColumn("_k", F.lit(1)).join(kept.withColumn("_k", F.lit(1)), "_k").drop("_k"))


_OPT = """sc AS (SELECT fold, m, ord, avg(sq) AS score FROM (SELECT fold, unnest([0, 1, 2, 3]) AS ord, unnest(['f0', 'f1', 'f2', 'f3']) AS m,
 unnest([(f0 - y) ** 2, (f1 - y) ** 2, (f2 - y) ** 2, (f3 - y) ** 2]) AS sq FROM files) GROUP BY fold, m, ord)"""


def option_scores(spark, sf):
    f = files(spark, sf)
    o = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("m"), F.pow(F.col(n) - F.col("y"), 2).alias("sq")) for i, n in enumerate(("f0", "f1", "f2", "f3"))])
    return f.select("fold", F.inline(o)).groupBy("fold", "m", "ord").agg(F.avg("sq").alias("score"))


@query("win16", rounded_sql("files", "fold, pick", f"""
WITH {_OPT}
SELECT fold, m AS pick, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score, ord) AS rn FROM sc) WHERE rn = 1""", 5))
def win16(spark, sf):
    return rounded(K.pick_best(option_scores(spark, sf), ["fold"], "m", "score", "ord"), 5)


@query("win17", with_ctes("files", f"""
WITH {_OPT}, p AS (SELECT m AS pick FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score, ord) AS rn FROM sc) WHERE rn = 1)
SELECT pick, count(*) AS count FROM p GROUP BY pick ORDER BY count(*) DESC, pick LIMIT 1"""))
def win17(spark, sf):
    return K.most_frequent(K.pick_best(option_scores(spark, sf), ["fold"], "m", "score", "ord"), "pick")
