"""Raster and component queries on 8 x 8 images."""

import math

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import components as CC
from ..operators import joins as J
from ..operators import raster as R
from .fixtures import labelmap, mask, pixels, rounded, rounded_sql, table, with_ctes
from .registry import query


def neg():
    return F.col("v") < 0


_ADJ = """adj AS (SELECT a.img, a.lab AS l1, b.lab AS l2 FROM labelmap a JOIN labelmap b
  ON a.img = b.img AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)))"""


def refl(c, n=8):
    return f"CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} >= {n} THEN {2 * n - 1} - ({c}) ELSE {c} END"


def smooth_cte(name, kernel, src="pixels", c="v"):
    r = len(kernel) // 2
    vals = ", ".join(f"({k - r}, {w!r}::DOUBLE)" for k, w in enumerate(kernel))
    return f"""k_{name}(o, w) AS (VALUES {vals}),
h_{name} AS (SELECT p.img, p.y, p.x, sum(w * q.{c}) AS v FROM {src} p, k_{name} JOIN {src} q ON q.img = p.img AND q.y = p.y AND q.x = {refl('p.x + o')} GROUP BY p.img, p.y, p.x),
{name} AS (SELECT p.img, p.y, p.x, sum(w * q.v) AS v FROM h_{name} p, k_{name} JOIN h_{name} q ON q.img = p.img AND q.x = p.x AND q.y = {refl('p.y + o')} GROUP BY p.img, p.y, p.x)"""


_GRAD = """g AS (SELECT img, y, x, v,
 CASE WHEN x = 0 THEN lead(v) OVER r - v WHEN x = 7 THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2 END AS gx,
 CASE WHEN y = 0 THEN lead(v) OVER c - v WHEN y = 7 THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2 END AS gy
 FROM pixels WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y))"""
K3 = [1 / 3] * 3
G1 = R.gaussian_kernel(1.0, 3)


@query("ras01", rounded_sql("pixels", "img, y, x", f"""
WITH {smooth_cte('s', G1)}
SELECT img, y, x, v FROM s"""))
def ras01(spark, sf):
    return rounded(R.smooth(pixels(spark, sf), G1))


@query("ras02", rounded_sql("pixels", "img, y, x", f"WITH {_GRAD}\nSELECT img, y, x, sqrt(gx * gx + gy * gy) AS gm FROM g"))
def ras02(spark, sf):
    return rounded(R.gradient(pixels(spark, sf)).select("img", "y", "x", "gm"))


@query("ras03", rounded_sql("pixels", "img", f"""
WITH {_GRAD}, j AS (SELECT img, avg(gx * gx) AS a, avg(gy * gy) AS b, avg(gx * gy) AS c FROM g GROUP BY img),
e AS (SELECT *, a + b AS tr, sqrt((a - b) ** 2 + 4 * c * c) AS d FROM j)
SELECT img, d / (tr + 1e-9) AS coh, ((tr - d) / 2) / ((tr + d) / 2 + 1e-9) AS ratio, 0.5 * atan2(2 * c, a - b) AS angle FROM e"""))
def ras03(spark, sf):
    return rounded(R.structure_tensor(pixels(spark, sf)))


def _cross(cols, level, start, default):
    out = f"{float(default)}"
    for r in range(len(cols) - 1, start - 1, -1):
        p0, p1 = cols[r - 1], cols[r]
        out = f"CASE WHEN {p1} < {level} THEN CASE WHEN {p0} >= {level} THEN {r - 1} + ({p0} - {level}) / greatest({p0} - {p1}, 1e-9) ELSE {float(r)} END ELSE {out} END"
    return out


@query("ras04", rounded_sql("pixels", "img", """
WITH z AS (SELECT *, v - avg(v) OVER (PARTITION BY img) AS z FROM pixels), v0 AS (SELECT img, avg(z * z) AS v0 FROM z GROUP BY img),
l AS (SELECT a.img, k, avg(CASE WHEN b.y = a.y AND b.x = a.x + k THEN a.z * b.z END) AS ax, avg(CASE WHEN b.x = a.x AND b.y = a.y + k THEN a.z * b.z END) AS ay
 FROM z a JOIN z b USING (img), (SELECT unnest([1, 2, 3]) AS k) GROUP BY a.img, k),
p AS (SELECT img, """ + ", ".join(f"max(CASE WHEN k = {k} THEN a{a} / v0 END) AS ac_{a}{k}" for a in "xy" for k in (1, 2, 3)) + f""" FROM l JOIN v0 USING (img) GROUP BY img)
SELECT img, (ac_x1 + ac_y1) / 2 AS lag1, ac_x1, ac_x2, ac_x3, ac_y1, ac_y2, ac_y3,
 {_cross(['1', 'ac_x1', 'ac_x2', 'ac_x3'], 0.5, 1, 3)} AS len_x, {_cross(['1', 'ac_y1', 'ac_y2', 'ac_y3'], 0.5, 1, 3)} AS len_y FROM p"""))
def ras04(spark, sf):
    return rounded(R.lag_autocorrelation(pixels(spark, sf), 3, 0.5))


_RBLK = f"""
d AS (SELECT *, (y // 4) * 2 + x // 4 AS blk, CASE WHEN v > -0.3 THEN 1e0 ELSE 0e0 END AS w FROM pixels),
z AS (SELECT *, (v - sum(v * w) OVER (PARTITION BY img, blk) / greatest(sum(w) OVER (PARTITION BY img, blk), 1)) * w AS z FROM d),
o AS (SELECT a.img, a.blk, b.y - a.y AS dy, b.x - a.x AS dx, sum(a.z * b.z) / greatest(sum(a.w * b.w), 1) AS ac FROM z a JOIN z b ON a.img = b.img AND a.blk = b.blk GROUP BY ALL),
pr AS (SELECT img, blk, CAST(round(sqrt(dy * dy + dx * dx)) AS INTEGER) AS r, avg(ac) AS p FROM o GROUP BY 1, 2, 3),
pw AS (SELECT img, blk, max(CASE WHEN r = 0 THEN p END) AS p0, max(CASE WHEN r = 1 THEN p END) AS q1, max(CASE WHEN r = 2 THEN p END) AS q2, max(CASE WHEN r = 3 THEN p END) AS q3 FROM pr GROUP BY img, blk),
pn AS (SELECT img, blk, q1 / p0 AS p1, q2 / p0 AS p2, q3 / p0 AS p3 FROM pw),
rb AS (SELECT img, CAST(blk AS INTEGER) AS blk, p1, p2, p3, {_cross(['1', 'p1', 'p2', 'p3'], 0.5, 2, 3)} AS len FROM pn)"""


def _rblocks(spark, sf):
    return R.radial_block_autocorrelation(pixels(spark, sf), F.col("v") > -0.3, B.grid_index(8, 2), 3)


@query("ras05", rounded_sql("pixels", "img, blk", f"WITH {_RBLK}\nSELECT * FROM rb", 5))
def ras05(spark, sf):
    return rounded(_rblocks(spark, sf), 5)


@query("ras06", rounded_sql("pixels", "img", """
WITH z AS (SELECT *, v - avg(v) OVER (PARTITION BY img) AS z FROM pixels),
k AS (SELECT unnest(range(-4, 4)) AS k),
p AS (SELECT img, ky.k AS ky, kx.k AS kx, pow(sum(z * cos(2 * pi() * (ky.k * y + kx.k * x) / 8)), 2) + pow(sum(z * sin(2 * pi() * (ky.k * y + kx.k * x) / 8)), 2) AS p FROM z, k ky, k kx GROUP BY 1, 2, 3),
r AS (SELECT img, floor(sqrt(ky * ky + kx * kx)) AS r, avg(p) AS p FROM p GROUP BY 1, 2), t AS (SELECT * FROM r WHERE r BETWEEN 1 AND 3)
SELECT img, sum(CASE WHEN r = 1 THEN p ELSE 0 END) / (sum(p) + 1e-12) AS fft_1_2, sum(CASE WHEN r >= 2 THEN p ELSE 0 END) / (sum(p) + 1e-12) AS fft_2_4, sum(p * r) / (sum(p) + 1e-12) AS fft_centroid FROM t GROUP BY img"""))
def ras06(spark, sf):
    return rounded(R.spectrum_bands(pixels(spark, sf), 8, 4, [1, 2, 4]))


@query("ras06_profile", rounded_sql("pixels", "img, r", """
SELECT img, CAST(floor(sqrt((y - 3.5) ** 2 + (x - 3.5) ** 2)) AS INTEGER) AS r, avg(v) AS v FROM pixels GROUP BY 1, 2"""))
def ras06_profile(spark, sf):
    return rounded(R.radial_profile(pixels(spark, sf), 3.5))


@query("ras07", rounded_sql("pixels", "img", """
WITH q AS (SELECT *, CAST(floor((greatest(-0.5, least(0.499, v)) + 0.5) * 8) AS INTEGER) AS q FROM pixels),
o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, 1, 0), (3, 1, 1)) t(a, dy, dx)),
s AS (SELECT p.img, a, p.q AS i, n.q AS j FROM q p, o JOIN q n ON n.img = p.img AND n.y = p.y + dy AND n.x = p.x + dx),
b AS (SELECT img, a, i, j FROM s UNION ALL SELECT img, a, j, i FROM s), c AS (SELECT img, a, i, j, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL),
m AS (SELECT img, a, sum(n * (i - j) ** 2) / sum(n) AS con, sum(n / (1 + (i - j) ** 2)) / sum(n) AS hom, sum(n * i) / sum(n) AS mu,
  sum(n * i * i) / sum(n) AS ii, sum(n * i * j) / sum(n) AS ij, sqrt(sum(n * n)) / sum(n) AS ene FROM c GROUP BY img, a),
e AS (SELECT *, CASE WHEN ii - mu * mu > 1e-12 THEN (ij - mu * mu) / (ii - mu * mu) ELSE 1 END AS cor FROM m)
SELECT img, avg(con) AS contrast, avg(hom) AS homogeneity, avg(cor) AS correlation, avg(ene) AS energy, max(con) - min(con) AS contrast_aniso,
 max(hom) - min(hom) AS homogeneity_aniso, max(cor) - min(cor) AS correlation_aniso, max(ene) - min(ene) AS energy_aniso FROM e GROUP BY img"""))
def ras07(spark, sf):
    lv = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.499), F.col("v"))) + 0.5) * 8).cast("int")
    return rounded(R.cooccurrence(pixels(spark, sf), lv))


@query("ras08", rounded_sql("pixels", "img", """
WITH o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) t(k, dy, dx)),
b AS (SELECT p.img, p.y, p.x, k, CAST(coalesce(n.v, 0) >= p.v AS INTEGER) AS b FROM pixels p CROSS JOIN o LEFT JOIN pixels n ON n.img = p.img AND n.y = p.y + dy AND n.x = p.x + dx),
l AS (SELECT img, y, x, list(b ORDER BY k) AS l FROM b GROUP BY img, y, x),
c AS (SELECT img, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: abs(l[i] - l[i % 8 + 1]))) <= 2 THEN list_sum(l) ELSE 9 END AS c FROM l)
SELECT img, """ + ", ".join(f"avg(CASE WHEN c = {k} THEN 1e0 ELSE 0e0 END) AS lbp{k}" for k in range(10)) + " FROM c GROUP BY img"))
def ras08(spark, sf):
    return rounded(R.binary_pattern_histogram(pixels(spark, sf)))


@query("ras09", rounded_sql("pixels", "img", """
WITH q AS (SELECT img, quantile_cont(v, [0.7, 0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM pixels GROUP BY img)
SELECT img, avg((v < q[1] - 0.08)::INT) AS px8, avg((v < q[1] - 0.16)::INT) AS px16, avg(greatest(0, q[1] - v)) AS deficit, avg(greatest(0, v - q[1])) AS excess,
 avg(greatest(0, least(1, (q[1] - v) / 0.2))) AS soft, any_value(q[2]) AS p5, any_value(q[3]) AS p25, any_value(q[4]) AS p50, any_value(q[5]) AS p75, any_value(q[6]) AS p95
FROM pixels JOIN q USING (img) WHERE v > -0.35 GROUP BY img"""))
def ras09(spark, sf):
    return rounded(R.level_fractions(pixels(spark, sf), F.col("v") > -0.35, [0.08, 0.16]))


@query("ras10", with_ctes("pixels", """
WITH b AS (SELECT img, CAST(floor((greatest(-0.5, least(0.4999, v)) + 0.5) * 16) AS INTEGER) AS b FROM pixels),
h AS (SELECT i.img, k, CAST(count(b.b) AS DOUBLE) AS n FROM (SELECT DISTINCT img FROM b) i CROSS JOIN (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS k) LEFT JOIN b ON b.img = i.img AND b.b = k GROUP BY 1, 2),
md AS (SELECT img, arg_max(k, n * 100 - k) AS mode FROM h GROUP BY img),
c AS (SELECT img, k, sum(n) OVER w AS w, sum(n * k) OVER w AS s, sum(n) OVER (PARTITION BY img) AS tw, sum(n * k) OVER (PARTITION BY img) AS ts FROM h WINDOW w AS (PARTITION BY img ORDER BY k)),
t2 AS (SELECT img, k AS t, round(CASE WHEN w > 0 THEN s * s / w ELSE 0 END + CASE WHEN tw - w > 0 THEN (ts - s) ** 2 / (tw - w) ELSE 0 END, 9) AS v FROM c WHERE k <= 14),
o2 AS (SELECT img, t AS otsu FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, t) AS rn FROM t2) WHERE rn = 1),
t3 AS (SELECT a.img, a.k AS t1, b.k AS t2, round(CASE WHEN a.w > 0 THEN a.s * a.s / a.w ELSE 0 END + CASE WHEN b.w - a.w > 0 THEN (b.s - a.s) ** 2 / (b.w - a.w) ELSE 0 END
  + CASE WHEN b.tw - b.w > 0 THEN (b.ts - b.s) ** 2 / (b.tw - b.w) ELSE 0 END, 9) AS v FROM c a JOIN c b ON a.img = b.img AND a.k < b.k WHERE a.k <= 13 AND b.k <= 14),
o3 AS (SELECT img, t1, t2 FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, t1, t2) AS rn FROM t3) WHERE rn = 1)
SELECT img, mode, otsu, t1, t2 FROM md JOIN o2 USING (img) JOIN o3 USING (img)"""))
def ras10(spark, sf):
    b = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.4999), F.col("v"))) + 0.5) * 16).cast("int")
    return R.histogram_thresholds(pixels(spark, sf), b, 16)


@query("ras11", with_ctes("mask", """
WITH o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
e AS (SELECT p.img, p.y, p.x, min(n.m::INT) AS e, max(n.m::INT) AS d FROM mask p, o JOIN mask n ON n.img = p.img AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY 1, 2, 3),
op AS (SELECT p.img, p.y, p.x, max(n.e) AS o FROM e p, o JOIN e n ON n.img = p.img AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY 1, 2, 3)
SELECT img, y, x, CAST(e AS INTEGER) AS eroded, CAST(d AS INTEGER) AS dilated, CAST(o AS INTEGER) AS opened FROM e JOIN op USING (img, y, x)"""))
def ras11(spark, sf):
    m = mask(spark, sf).withColumn("m", F.col("m").cast("int"))
    d = R.disk_filter(m, "m", 1, "min", "eroded")
    d = R.disk_filter(d, "m", 1, "max", "dilated")
    return R.opening(d, "m", 1, "opened").select("img", "y", "x", "eroded", "dilated", "opened")


_COMP = """
pm AS (SELECT img, y, x, y * 8 + x AS node FROM mask WHERE m),
reach(img, node, src) AS (SELECT img, node, node FROM pm UNION
 SELECT r.img, n.node, r.src FROM reach r JOIN pm p ON p.img = r.img AND p.node = r.node JOIN pm n ON n.img = p.img AND abs(n.y - p.y) <= 1 AND abs(n.x - p.x) <= 1),
comp AS (SELECT img, node, CAST(min(src) AS INTEGER) AS comp FROM reach GROUP BY img, node)"""


def _mask_components(spark, sf):
    m = mask(spark, sf)
    return m, CC.raster_components(m, F.when(F.col("m"), 1).otherwise(-1), eight=True)


@query("ras12", rounded_sql("mask", "img, n, span, max_ext", f"""
WITH {_COMP},
t AS (SELECT img, comp, count(*) AS a, max(node // 8) - min(node // 8) AS ey, max(node % 8) - min(node % 8) AS ex,
  (min(node // 8) = 0 AND max(node // 8) = 7) OR (min(node % 8) = 0 AND max(node % 8) = 7) AS sp FROM comp GROUP BY img, comp HAVING count(*) >= 3)
SELECT img, count(*) AS n, max(a) / 64 AS max_img, max(a) / sum(a) AS max_share, sum(a * a) / sum(a) / 64 AS wmean_img, max(sp::INT) AS span, CAST(max(greatest(ey, ex)) AS INTEGER) AS max_ext FROM t GROUP BY img"""))
def ras12(spark, sf):
    m, comp = _mask_components(spark, sf)
    return rounded(CC.component_stats(CC.component_table(m, comp, 3, 8), 8))


@query("ras13")
def ras13(spark, sf):
    m, comp = _mask_components(spark, sf)
    return rounded(CC.blob_table(CC.component_table(m, comp, 3, 8), 8))


@query("ras14", with_ctes("mask", """
WITH s AS (SELECT img, 2 * y AS a, 2 * x AS b FROM mask WHERE m),
c AS (SELECT DISTINCT img, a + da AS a, b + db AS b, CASE WHEN da <> 0 AND db <> 0 THEN 1 WHEN da = 0 AND db = 0 THEN 1 ELSE -1 END AS k
 FROM s, (SELECT unnest([-1, 0, 1]) AS da), (SELECT unnest([-1, 0, 1]) AS db))
SELECT img, sum(k) / 64 AS euler FROM c GROUP BY img"""))
def ras14(spark, sf):
    return R.euler_density(mask(spark, sf), F.col("m"), 8)


@query("ras15", rounded_sql("mask", "img", """
WITH p AS (SELECT img, avg(m::INT) AS p FROM mask GROUP BY img),
s AS (SELECT a.img, r, avg(CASE WHEN b.y = a.y AND b.x = a.x + r THEN (a.m AND b.m)::INT END) AS sx, avg(CASE WHEN b.x = a.x AND b.y = a.y + r THEN (a.m AND b.m)::INT END) AS sy
 FROM mask a JOIN mask b USING (img), (SELECT unnest([1, 2]) AS r) GROUP BY a.img, r)
SELECT img, any_value(p) AS p, """ + ", ".join(f"max(CASE WHEN r = {r} THEN (s{a} - p * p) / greatest(p - p * p, 1e-6) END) AS s2_{a}{r}" for a in "xy" for r in (1, 2)) + " FROM s JOIN p USING (img) GROUP BY img"))
def ras15(spark, sf):
    return rounded(R.two_point(mask(spark, sf), F.col("m"), [1, 2]))


@query("ras16", rounded_sql("mask", "img", """
WITH s AS (SELECT a.img, a.y, a.x, k, count(b.m) FILTER (WHERE b.y = a.y AND b.x BETWEEN a.x AND a.x + k - 1 AND b.m) AS nx,
 count(b.m) FILTER (WHERE b.x = a.x AND b.y BETWEEN a.y AND a.y + k - 1 AND b.m) AS ny FROM mask a JOIN mask b USING (img), (SELECT unnest([2, 3]) AS k) GROUP BY 1, 2, 3, 4)
SELECT img, """ + ", ".join(f"sum(CASE WHEN k = {k} AND n{a} = {k} THEN 1 ELSE 0 END) / {8 * (8 - k + 1)}.0 AS lp_{a}{k}" for a in "xy" for k in (2, 3)) + " FROM s GROUP BY img"))
def ras16(spark, sf):
    return rounded(R.lineal_path(mask(spark, sf), F.col("m"), [2, 3], 8))


@query("ras17", rounded_sql("pixels", "img, y, x", """
WITH b AS (SELECT img, y // 2 AS cy, x // 2 AS cx, avg(v + 1) AS v FROM pixels GROUP BY 1, 2, 3),
l AS (SELECT a.img, a.cy, a.cx, quantile_cont(b.v, 0.7) AS bg FROM b a JOIN b ON a.img = b.img AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 GROUP BY 1, 2, 3)
SELECT p.img, y, x, bg, (v + 1) / bg AS ratio FROM pixels p JOIN l ON l.img = p.img AND l.cy = y // 2 AND l.cx = x // 2"""))
def ras17(spark, sf):
    return rounded(R.background_ratio(pixels(spark, sf).withColumn("v", F.col("v") + 1), 2, 1, 0.7))


_LMG = "lg AS (SELECT *, v - avg(v) OVER (PARTITION BY img) AS d FROM (SELECT img, CAST(y // 2 AS INTEGER) AS cy, CAST(x // 2 AS INTEGER) AS cx, avg(v) AS v FROM pixels GROUP BY 1, 2, 3))"


@query("ras18", rounded_sql("pixels", "img, cy, cx", f"WITH {_LMG}\nSELECT * FROM lg"))
def ras18(spark, sf):
    return rounded(R.local_minus_global(pixels(spark, sf), 2))


@query("ras19", rounded_sql("pixels", "cy, cx, n", f"""
WITH {_LMG}
SELECT cy, cx, corr(d, label) AS r, count(*) AS n FROM lg JOIN embeddings ON vec_id = img GROUP BY cy, cx"""))
def ras19(spark, sf):
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.col("label").cast("double").alias("t"))
    return rounded(R.location_correlation(R.local_minus_global(pixels(spark, sf), 2).join(t, "img"), "d", "t"))


@query("ras19_max", rounded_sql("pixels", "cy, cx", f"""
WITH {_LMG}, c AS (SELECT cy, cx, corr(d, label) AS r FROM lg JOIN embeddings ON vec_id = img GROUP BY cy, cx)
SELECT cy, cx, r FROM (SELECT * FROM c ORDER BY abs(r) DESC LIMIT 1)"""))
def ras19_max(spark, sf):
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.col("label").cast("double").alias("t"))
    cm = R.location_correlation(R.local_minus_global(pixels(spark, sf), 2).join(t, "img"), "d", "t")
    return rounded(R.strongest_location(cm))


@query("ras20", rounded_sql("pixels", "img", f"""
WITH {_RBLK}, dk AS (SELECT img, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS blk, avg((v < 0)::INT) AS dk FROM pixels GROUP BY 1, 2), j AS (SELECT * FROM rb JOIN dk USING (img, blk))
SELECT img, avg(len) AS gm_mean, stddev_pop(len) / greatest(avg(len), 1e-6) AS gm_cv, max(len) / greatest(min(len), 0.5) AS gm_maxmin,
 avg(pow(len, 4)) / greatest(pow(avg(len * len), 2), 1e-9) AS w_over_n, stddev_pop(dk) AS dk_sd, CASE WHEN stddev_pop(len) > 1e-9 AND stddev_pop(dk) > 1e-9 THEN corr(len, dk) ELSE 0 END AS corr_size_dk FROM j GROUP BY img""", 5))
def ras20(spark, sf):
    dk = pixels(spark, sf).groupBy("img", B.grid_index(8, 2).alias("blk")).agg(F.avg(neg().cast("double")).alias("dk"))
    return rounded(R.local_size_spread(_rblocks(spark, sf), dk), 5)


@query("ras21", rounded_sql("pixels", "img", """
SELECT img, covar_pop(y, v) / var_pop(y) AS slope_y, covar_pop(x, v) / var_pop(x) AS slope_x,
 sqrt(greatest(0, var_pop(v) - covar_pop(y, v) ** 2 / var_pop(y) - covar_pop(x, v) ** 2 / var_pop(x))) AS resid_sd FROM pixels GROUP BY img"""))
def ras21(spark, sf):
    return rounded(R.plane_fit(pixels(spark, sf), "img", "y", "x", "v"))


@query("ras23", rounded_sql("pixels", "img, blk", """
WITH l AS (SELECT img, y, x, k, CAST(floor((v + 1) * 4 + 0.25 * k) AS INTEGER) AS lab FROM pixels, (SELECT unnest([0, 1, 2]) AS k)),
a AS (SELECT img, y, x, count(*) OVER (PARTITION BY img, k, lab) AS a FROM l), m AS (SELECT img, y, x, CAST(median(a) AS DOUBLE) AS a FROM a GROUP BY 1, 2, 3)
SELECT img, CAST((y // 2) * 4 + x // 2 AS INTEGER) AS blk, -2 * ln(avg(pow(a, -0.5))) AS b FROM m GROUP BY 1, 2"""))
def ras23(spark, sf):
    px = pixels(spark, sf)
    for k in range(3):
        px = B.with_region_area(px.withColumn(f"lab{k}", F.floor((F.col("v") + 1) * 4 + 0.25 * k).cast("int")), f"lab{k}").withColumnRenamed("a", f"a{k}")
    return rounded(B.block_power_mean(R.consensus_area(px, ["a0", "a1", "a2"]), F.lit(True), 8, 4))


@query("ras24", rounded_sql("labelmap", "img", f"""
WITH {_ADJ}, s AS (SELECT img, sum((l1 < 4 AND l2 < 4)::INT) AS dd, sum(((l1 < 4) <> (l2 < 4))::INT) AS dm, count(*) AS n FROM adj WHERE l1 <> l2 GROUP BY img)
SELECT img, 2 * dd / greatest(2 * dd + dm, 1) AS contiguity_dd, dd / n AS dd_line_frac FROM s"""))
def ras24(spark, sf):
    return rounded(R.phase_contiguity(J.adjacency(labelmap(spark, sf)), F.col("l1") < 4, F.col("l2") < 4))


_V1 = "v1 AS (SELECT img, y, x, v + 1 AS v FROM pixels)"


@query("ras25", rounded_sql("pixels", "img", f"""
WITH {_V1}, {smooth_cte('b', K3, 'v1')}, {smooth_cte('h', [1 / 7] * 7, 'v1')},
d AS (SELECT v1.img, v1.v, v1.v - b.v AS lap, h.v AS h FROM v1 JOIN b USING (img, y, x) JOIN h USING (img, y, x)),
s AS (SELECT img, quantile_cont(v, [0.05, 0.7, 0.95]) AS q, quantile_cont(h, [0.05, 0.95]) AS hq, median(lap) AS m FROM d GROUP BY img),
n AS (SELECT img, 1.4826 * median(abs(lap - m)) AS noise FROM d JOIN s USING (img) GROUP BY img)
SELECT img, q[1] / q[2] AS dark_ratio, q[3] / q[2] AS bright_ratio, noise, (hq[2] - hq[1]) / q[2] AS illum_range FROM s JOIN n USING (img)"""))
def ras25(spark, sf):
    return rounded(R.quality_descriptors(pixels(spark, sf).withColumn("v", F.col("v") + 1)))


@query("ras26", rounded_sql("pixels", "img", f"""
WITH {smooth_cte('s', K3)}, j AS (SELECT p.img, p.v, s.v AS w, p.v < 0 AS m FROM pixels p JOIN s USING (img, y, x))
SELECT img, -10 * log10(avg((v - w) ** 2)) AS psnr, -10 * log10(avg((v - w) ** 2) FILTER (WHERE m)) AS psnr_mask, corr(v, w) AS corr,
 (avg(w) FILTER (WHERE NOT m) - avg(w) FILTER (WHERE m)) / greatest(avg(v) FILTER (WHERE NOT m) - avg(v) FILTER (WHERE m), 1e-3) AS contrast FROM j GROUP BY img"""))
def ras26(spark, sf):
    px = pixels(spark, sf)
    return rounded(R.fidelity(px, R.smooth(px, K3), neg()))


_PIECES = """
pp AS (SELECT img, y, x, y * 8 + x AS node, lab, v FROM labelmap),
reach(img, node, src) AS (SELECT img, node, node FROM pp UNION
 SELECT r.img, n.node, r.src FROM reach r JOIN pp p ON p.img = r.img AND p.node = r.node JOIN pp n ON n.img = p.img AND n.lab = p.lab AND abs(n.y - p.y) + abs(n.x - p.x) = 1),
pc AS (SELECT img, node, CAST(min(src) AS INTEGER) AS piece FROM reach GROUP BY img, node),
pieces AS (SELECT pp.*, piece FROM pp JOIN pc USING (img, node)),
pa AS (SELECT a.img, a.piece AS l1, b.piece AS l2, a.lab AS lab1, b.lab AS lab2 FROM pieces a JOIN pieces b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1)"""


@query("ras27", rounded_sql("labelmap", "img, ncluster, span", f"""
WITH {_PIECES},
fe AS (SELECT DISTINCT img, l1, l2 FROM pa WHERE l1 <> l2 AND lab1 < 4 AND lab2 < 4),
fv AS (SELECT img, piece, count(*) AS a, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM pieces WHERE lab < 4 GROUP BY img, piece),
cl(img, node, src) AS (SELECT img, piece, piece FROM fv UNION SELECT c.img, e.l2, c.src FROM cl c JOIN fe e ON e.img = c.img AND e.l1 = c.node),
cc AS (SELECT img, node, min(src) AS comp FROM cl GROUP BY img, node),
ct AS (SELECT c.img, comp, sum(a) AS a, (min(y0) = 0 AND max(y1) = 7) OR (min(x0) = 0 AND max(x1) = 7) AS sp FROM cc c JOIN fv ON fv.img = c.img AND fv.piece = c.node GROUP BY c.img, comp)
SELECT img, count(*) AS ncluster, max(a) / 64 AS max_frac, max(a) / sum(a) AS max_share, sum(a * a) / sum(a) / 64 AS wmean, CAST(max(sp::INT) AS INTEGER) AS span FROM ct GROUP BY img"""))
def ras27(spark, sf):
    p = CC.relabel_pieces(labelmap(spark, sf), "lab").withColumn("dk", F.col("lab") < 4)
    return rounded(CC.flagged_clusters(p, "dk", 8))


def _runs_sql(axis, line):
    return f"""SELECT img, {line} AS line, '{axis}' AS axis, bool_and(m) AS m, count(*) AS len, min({axis}) = 0 OR max({axis}) = 7 AS open FROM (
 SELECT *, sum(c) OVER (PARTITION BY img, {line} ORDER BY {axis}) AS r FROM (SELECT *, CASE WHEN m = lag(m) OVER (PARTITION BY img, {line} ORDER BY {axis}) THEN 0 ELSE 1 END AS c FROM mask)) GROUP BY img, {line}, r"""


@query("ras28", rounded_sql("mask", "img", f"""
WITH r AS ({_runs_sql('x', 'y')} UNION ALL {_runs_sql('y', 'x')}),
s AS (SELECT img, avg(len) FILTER (WHERE axis = 'x' AND m AND NOT open) AS chord_par, avg(len) FILTER (WHERE axis = 'x' AND NOT m AND NOT open) AS gap_par,
 avg(len) FILTER (WHERE axis = 'y' AND m AND NOT open) AS chord_perp, avg(len) FILTER (WHERE axis = 'y' AND NOT m AND NOT open) AS gap_perp FROM r GROUP BY img)
SELECT *, chord_par / chord_perp AS chord_aspect FROM s"""))
def ras28(spark, sf):
    return rounded(R.chord_stats(mask(spark, sf), F.col("m")))


_ANGLES = {0: 0.0, 45: math.pi / 4, 27: 27 * math.pi / 180}


def _chords_sql(name, angle, tag):
    c, s = repr(math.cos(angle)), repr(math.sin(angle))
    return f"""SELECT '{name}' AS axis, '{tag}' AS tag, img, line, bool_and(m) AS m, count(*) AS len, min(t) = any_value(a) OR max(t) = any_value(b) AS open FROM (
 SELECT *, sum(c) OVER (PARTITION BY img, line ORDER BY t) AS r, min(t) OVER (PARTITION BY img, line) AS a, max(t) OVER (PARTITION BY img, line) AS b FROM (
 SELECT *, CASE WHEN m = lag(m) OVER (PARTITION BY img, line ORDER BY t) THEN 0 ELSE 1 END AS c FROM (
 SELECT img, g.l AS line, g.t AS t, m FROM (SELECT a.t, b.l FROM (SELECT unnest(range(-12, 13)) AS t) a, (SELECT unnest(range(-12, 13)) AS l) b) g
 JOIN mask ON mask.x = CAST(floor(g.t * {c} - g.l * {s} + 0.5) AS INTEGER) AND mask.y = CAST(floor(g.t * {s} + g.l * {c} + 0.5) AS INTEGER)))) GROUP BY img, line, r"""


@query("ras28_axes", rounded_sql("mask", "img, axis", "WITH r AS (" + " UNION ALL ".join(
    _chords_sql(n, a + turn, tag) for n, a in _ANGLES.items() for tag, turn in (("par", 0.0), ("perp", math.pi / 2))) + """),
s AS (SELECT img, CAST(axis AS INTEGER) AS axis, """ + ", ".join(
    f"avg(len) FILTER (WHERE tag = '{t}' AND m AND NOT open) AS chord_{t}, median(len) FILTER (WHERE tag = '{t}' AND m AND NOT open) AS chord_{t}_med, "
    f"avg(len) FILTER (WHERE tag = '{t}' AND NOT m AND NOT open) AS gap_{t}, count(*) FILTER (WHERE tag = '{t}' AND m AND NOT open) * 1000 / sum(len) FILTER (WHERE tag = '{t}') AS nchord_{t}"
    for t in ("par", "perp")) + """ FROM r GROUP BY img, axis)
SELECT *, chord_par / chord_perp AS chord_aspect FROM s"""))
def ras28_axes(spark, sf):
    """Chords at 0, 45 and 27 degrees and across each."""
    m = mask(spark, sf)
    parts = [R.chords(m, F.col("m"), a).withColumn("axis", F.lit(n)) for n, a in _ANGLES.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("ras29", with_ctes("labelmap", f"""
WITH {_PIECES}, sz AS (SELECT img, piece, count(*) AS n FROM pieces GROUP BY img, piece),
ct AS (SELECT pa.img, l1, l2, count(*) AS c FROM pa JOIN sz a ON a.img = pa.img AND a.piece = l1 JOIN sz b ON b.img = pa.img AND b.piece = l2 WHERE l1 <> l2 AND a.n < 3 AND b.n >= 3 GROUP BY 1, 2, 3),
tt AS (SELECT img, l1 AS piece, l2 AS t FROM (SELECT *, row_number() OVER (PARTITION BY img, l1 ORDER BY c DESC, l2) AS rn FROM ct) WHERE rn = 1)
SELECT img, y, x, lab, CAST(coalesce(t, piece) AS INTEGER) AS piece FROM pieces LEFT JOIN tt USING (img, piece)"""))
def ras29(spark, sf):
    p = CC.relabel_pieces(labelmap(spark, sf), "lab").drop("v")
    return CC.merge_small_pieces(p, 3).select("img", "y", "x", "lab", "piece")


# ---------------------------------------------------------------- raster based aggregates
def _mad(expr, m):
    return f"1.4826 * median(abs({expr} - {m}))"


@query("agg50", rounded_sql("pixels", "img", f"""
WITH {_GRAD}, {smooth_cte('b', K3)},
d AS (SELECT g.img, (g.y // 4) * 2 + g.x // 4 AS blk, g.v, g.v - b.v AS lap, sqrt(gx * gx + gy * gy) AS gm FROM g JOIN b USING (img, y, x)),
s AS (SELECT img, blk, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, median(lap) AS m, avg(gm) AS edge FROM d GROUP BY img, blk),
n AS (SELECT img, blk, {_mad('lap', 'm')} AS noise FROM d JOIN s USING (img, blk) GROUP BY img, blk), t AS (SELECT * FROM s JOIN n USING (img, blk))
SELECT img, """ + ", ".join(f"stddev_pop({c}) AS {c}_sd, max({c}) - min({c}) AS {c}_rng" for c in ("mean", "std", "p5", "p95", "noise", "edge")) + " FROM t GROUP BY img"))
def agg50(spark, sf):
    return rounded(R.block_raster_stats(pixels(spark, sf), 2, 8))


@query("agg53", rounded_sql("labelmap", "img", f"""
WITH {smooth_cte('b1', R.gaussian_kernel(0.7, 2), 'labelmap')}, {smooth_cte('b2', R.gaussian_kernel(2.0, 3), 'labelmap')}, {smooth_cte('bx', K3, 'labelmap')},
d AS (SELECT l.img, lab, l.v, l.v - bx.v AS lap, b1.v - b2.v AS band FROM labelmap l JOIN b1 USING (img, y, x) JOIN b2 USING (img, y, x) JOIN bx USING (img, y, x)),
r AS (SELECT img, lab, avg(v) < 0 AS dk, stddev_pop(v) AS std, sqrt(avg(band * band)) AS band, median(lap) AS m FROM d GROUP BY img, lab HAVING count(*) >= 2),
n AS (SELECT img, lab, {_mad('lap', 'm')} AS lap FROM d JOIN r USING (img, lab) GROUP BY img, lab), t AS (SELECT * FROM r JOIN n USING (img, lab))
SELECT img, """ + ", ".join(f"median(ln(greatest({c}, 1e-6))) FILTER (WHERE {f}) AS tx_{c}_{p}_med, stddev_pop(ln(greatest({c}, 1e-6))) FILTER (WHERE {f}) AS tx_{c}_{p}_sd"
                            for c in ("lap", "std", "band") for p, f in (("dk", "dk"), ("mx", "NOT dk"))) + " FROM t GROUP BY img", 5))
def agg53(spark, sf):
    return rounded(R.interior_texture(labelmap(spark, sf), "lab", 0.0), 5)


_RHO = "rank() OVER (PARTITION BY img, measure, dk ORDER BY {0}) + (count(*) OVER (PARTITION BY img, measure, dk, {0}) - 1) / 2.0"


def _by_phase(prefix, measure, terms):
    return ", ".join(f"max({c}) FILTER (WHERE measure = '{measure}' AND {'' if p == 'dk' else 'NOT '}dk) AS {prefix}_{p}_{c}" for p in ("dk", "mx") for c in terms)


@query("agg53_spread", rounded_sql("labelmap", "img", f"""
WITH {smooth_cte('b1', R.gaussian_kernel(0.7, 2), 'labelmap')}, {smooth_cte('b2', R.gaussian_kernel(2.0, 3), 'labelmap')}, {smooth_cte('bx', K3, 'labelmap')},
d AS (SELECT l.img, lab, l.v, l.v - bx.v AS lap, b1.v - b2.v AS band FROM labelmap l JOIN b1 USING (img, y, x) JOIN b2 USING (img, y, x) JOIN bx USING (img, y, x)),
r AS (SELECT img, lab, count(*) AS size, round(avg(v), 9) AS lvl, avg(v) < 0 AS dk, stddev_pop(v) AS std, sqrt(avg(band * band)) AS band, median(lap) AS m FROM d GROUP BY img, lab HAVING count(*) >= 2),
n AS (SELECT img, lab, {_mad('lap', 'm')} AS lap FROM d JOIN r USING (img, lab) GROUP BY img, lab),
t AS (SELECT img, dk, size, lvl, unnest(['lap', 'std', 'band']) AS measure, unnest([lap, std, band]) AS raw FROM r JOIN n USING (img, lab)),
v AS (SELECT *, round(ln(greatest(raw, 1e-6)), 9) AS value FROM t),
k AS (SELECT *, {_RHO.format('value')} AS rv, {_RHO.format('size')} AS rs, {_RHO.format('lvl')} AS rl FROM v),
g AS (SELECT img, measure, dk, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, CASE WHEN count(*) >= 3 AND var_pop(rs) > 0 AND var_pop(rv) > 0 THEN corr(rv, rs) END AS rho_size,
 CASE WHEN count(*) >= 3 AND var_pop(rl) > 0 AND var_pop(rv) > 0 THEN corr(rv, rl) END AS rho_lvl FROM k GROUP BY img, measure, dk)
SELECT img, """ + ", ".join(_by_phase(f"tx_{m}", m, ("iqr", "rho_size", "rho_lvl")) + f", max(med) FILTER (WHERE measure = '{m}' AND dk) - max(med) FILTER (WHERE measure = '{m}' AND NOT dk) AS tx_{m}_dkmx"
                                for m in ("lap", "std", "band")) + " FROM g GROUP BY img", 5))
def agg53_spread(spark, sf):
    return rounded(R.texture_spread(labelmap(spark, sf), "lab", 0.0), 5)


@query("agg53_border", rounded_sql("labelmap", "img, n_borders", f"""
WITH {smooth_cte('b1', R.gaussian_kernel(1.0, 2), 'labelmap')},
e AS (SELECT img, y, x, lab, v, coalesce(lab <> lead(lab) OVER r, false) OR coalesce(lab <> lag(lab) OVER r, false) OR coalesce(lab <> lead(lab) OVER c, false) OR coalesce(lab <> lag(lab) OVER c, false) AS edge
 FROM labelmap WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
rg AS (SELECT e.img, lab, avg(e.v) < 0 AS dk, count(*) AS size, round(median(b1.v) FILTER (WHERE NOT edge) - avg(b1.v) FILTER (WHERE edge), 9) AS value, 'bc' AS measure FROM e JOIN b1 USING (img, y, x) GROUP BY e.img, lab),
k AS (SELECT *, {_RHO.format('value')} AS rv, {_RHO.format('size')} AS rs FROM rg WHERE value IS NOT NULL),
g AS (SELECT img, measure, dk, median(value) AS med, stddev_pop(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
 CASE WHEN count(*) >= 3 AND var_pop(rs) > 0 AND var_pop(rv) > 0 THEN corr(rv, rs) END AS rho_size FROM k GROUP BY img, measure, dk),
o AS (SELECT img, {_by_phase('bc', 'bc', ('med', 'sd', 'iqr', 'rho_size'))} FROM g GROUP BY img),
ad AS (SELECT img, lab AS l1, v AS v1, unnest([lead(lab) OVER r, lead(lab) OVER c]) AS l2, unnest([lead(v) OVER r, lead(v) OVER c]) AS v2 FROM labelmap WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
st AS (SELECT img, least(l1, l2) AS a, greatest(l1, l2) AS b, avg(abs(v1 - v2)) AS s FROM ad WHERE l1 <> l2 GROUP BY ALL),
sg AS (SELECT img, count(*) AS n_borders, median(s) AS step_med, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) AS step_iqr FROM st GROUP BY img)
SELECT i.img, o.* EXCLUDE (img), n_borders, step_med, step_iqr FROM (SELECT DISTINCT img FROM labelmap) i LEFT JOIN o ON o.img = i.img LEFT JOIN sg ON sg.img = i.img""", 5))
def agg53_border(spark, sf):
    return rounded(R.boundary_contrast(labelmap(spark, sf), "lab", 0.0), 5)


@query("agg56", rounded_sql("labelmap", "img", """
WITH l AS (SELECT *, (coalesce(lab <> lead(lab) OVER (PARTITION BY img, y ORDER BY x), false) OR coalesce(lab <> lead(lab) OVER (PARTITION BY img, x ORDER BY y), false))::INT AS line FROM labelmap),
h AS (SELECT p.img, p.y, p.x, any_value(p.v) AS v, any_value(p.line) AS line, max(n.v) AS hi, max(CASE WHEN (n.y - p.y) ** 2 + (n.x - p.x) ** 2 <= 1 THEN n.line END) AS near
 FROM l p JOIN l n ON n.img = p.img AND (n.y - p.y) ** 2 + (n.x - p.x) ** 2 <= 4 GROUP BY 1, 2, 3),
q AS (SELECT *, hi > 0.05 AS ok, v / greatest(hi, 0.05) AS ratio FROM h)
SELECT img, CASE WHEN count(*) FILTER (WHERE ok AND line = 1) > 5 THEN 1 - median(ratio) FILTER (WHERE ok AND line = 1) END AS bd_depth,
 CASE WHEN count(*) FILTER (WHERE ok AND near = 1) > 5 THEN avg((ratio < 0.97)::INT) FILTER (WHERE ok AND near = 1) END AS bd_width, avg(line) AS bd_line_frac FROM q GROUP BY img"""))
def agg56(spark, sf):
    return rounded(R.boundary_depth(labelmap(spark, sf), "lab", 0.05, 5))
