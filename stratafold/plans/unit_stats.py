"""Region and block statistic queries."""

import math

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import joins as J
from ..operators import units as U
from .fixtures import blocks, labelmap, mask, pixels, regions, rounded, rounded_sql, vectors, with_ctes
from .registry import query

def dark():
    return F.col("grey") < 0.91


TIE = ["okey", "line", "price", "cx"]
LOGE = [math.log(10), math.log(25), math.log(40)]
GRID16 = [(y, x) for y in range(32, 256, 64) for x in range(32, 256, 64)]

_AREA = "SELECT *, CAST(count(*) OVER (PARTITION BY img, lab) AS DOUBLE) AS a FROM labelmap"
_B4 = f"""
pa AS ({_AREA}),
b4 AS (SELECT img, (y // 2) * 4 + x // 2 AS blk, CASE WHEN count(CASE WHEN lab <> 2 THEN 1 END) >= 3
  THEN -2 * ln(avg(CASE WHEN lab <> 2 THEN pow(a, -0.5) END)) END AS b FROM pa GROUP BY 1, 2)"""


def _b4(spark, sf):
    px = B.with_region_area(labelmap(spark, sf))
    return px, B.block_power_mean(px, F.col("lab") != 2, 8, 4, 0.5, 3)


@query("agg08", with_ctes("labelmap", f"WITH {_B4}\nSELECT img, CAST(blk AS INTEGER) AS blk, round(b, 6) AS b FROM b4"))
def agg08(spark, sf):
    return rounded(_b4(spark, sf)[1])


@query("agg09", rounded_sql("labelmap", "img", f"""
WITH {_B4},
md AS (SELECT img, median(b) AS m, stddev_pop(b) AS het4 FROM b4 GROUP BY img),
mad AS (SELECT img, 1.4826 * median(abs(b - m)) AS het4_mad FROM b4 JOIN md USING (img) GROUP BY img),
b2 AS (SELECT img, (y // 4) * 2 + x // 4 AS blk, CASE WHEN count(CASE WHEN lab <> 2 THEN 1 END) >= 3 THEN -2 * ln(avg(CASE WHEN lab <> 2 THEN pow(a, -0.5) END)) END AS b FROM pa GROUP BY 1, 2),
h2 AS (SELECT img, stddev_pop(b) AS het2 FROM b2 GROUP BY img),
gm AS (SELECT img, blk, CASE WHEN sum(n) >= 3 THEN -2 * ln(avg(CASE WHEN n > 0 THEN pow(a, -0.5) END)) END AS b FROM (
  SELECT img, (y // 2) * 4 + x // 2 AS blk, lab, max(a) AS a, count(CASE WHEN lab <> 2 THEN 1 END) AS n FROM pa GROUP BY ALL) GROUP BY img, blk),
hg AS (SELECT img, stddev_pop(b) AS het4_gm FROM gm GROUP BY img)
SELECT img, het4, het4_mad, het2, het4_gm FROM md JOIN mad USING (img) JOIN h2 USING (img) JOIN hg USING (img)"""))
def agg09(spark, sf):
    px, b4 = _b4(spark, sf)
    ok = F.col("lab") != 2
    h4 = B.dispersion(b4, "b").select("img", F.col("sd").alias("het4"), F.col("mad").alias("het4_mad"))
    h2 = B.block_power_mean(px, ok, 8, 2, 0.5, 3).groupBy("img").agg(F.stddev_pop("b").alias("het2"))
    hg = B.block_unit_mean(px, ok, "lab", 8, 4, 3).groupBy("img").agg(F.stddev_pop("b").alias("het4_gm"))
    return rounded(h4.join(h2, "img").join(hg, "img"))


@query("agg10", with_ctes("regions", "SELECT img, CAST(sum(CASE WHEN border THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS n_eff FROM regions GROUP BY img"))
def agg10(spark, sf):
    return regions(spark, sf).groupBy("img").agg(U.jeffries().alias("n_eff"))


@query("agg11", with_ctes("labelmap", f"""
WITH {_B4}
SELECT img, CAST((blk // 4 // 2) * 2 + (blk % 4) // 2 AS INTEGER) AS blk, round(-2 * ln(avg(exp(-b / 2))), 6) AS b FROM b4 GROUP BY 1, 2"""))
def agg11(spark, sf):
    return rounded(B.cells_to_blocks(_b4(spark, sf)[1], 4, 2))


@query("agg12", rounded_sql("labelmap", "img, lab, area, y0, y1, x0, x1, border", """
SELECT img, lab, count(*) AS area, avg(y) AS cy, avg(x) AS cx, avg(v) AS mean, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
 min(y) = 0 OR min(x) = 0 OR max(y) = 7 OR max(x) = 7 AS border FROM labelmap GROUP BY img, lab"""))
def agg12(spark, sf):
    return rounded(U.region_table(labelmap(spark, sf)))


@query("agg13", rounded_sql("labelmap", "img, lab, area", """
WITH m AS (SELECT img, lab, count(*) AS area, var_pop(y) AS cyy, var_pop(x) AS cxx, covar_pop(y, x) AS cxy FROM labelmap GROUP BY img, lab),
e AS (SELECT *, (cyy + cxx) / 2 AS h, sqrt(greatest(0, pow((cyy + cxx) / 2, 2) - (cyy * cxx - cxy * cxy))) AS d FROM m)
SELECT img, lab, area, 4 * sqrt(h + d) AS maj, 4 * sqrt(greatest(0, h - d)) AS min, 4 * sqrt(h + d) / greatest(4 * sqrt(greatest(0, h - d)), 1) AS asp FROM e""", 5))
def agg13(spark, sf):
    return rounded(U.region_moments(labelmap(spark, sf)).drop("ori"), 5)


@query("agg13_axis", rounded_sql("labelmap", "img, lab", """
WITH m AS (SELECT img, lab, var_pop(y) AS cyy, var_pop(x) AS cxx, covar_pop(y, x) AS cxy FROM labelmap GROUP BY img, lab),
e AS (SELECT *, sqrt(pow((cyy - cxx) / 2, 2) + cxy * cxy) AS d FROM m)
SELECT img, lab, (cyy - cxx) / 2 / d AS cos2, cxy / d AS sin2 FROM e WHERE d > 1e-6"""))
def agg13_axis(spark, sf):
    """The main axis of every region that has one, as the double angle (an axis has no head)."""
    r = U.region_moments(labelmap(spark, sf)).where("maj * maj - min * min > 32e-6")
    return rounded(r.select("img", "lab", F.cos(2 * F.col("ori")).alias("cos2"), F.sin(2 * F.col("ori")).alias("sin2")))


_OP = "sqrt(pow(sum({w} * cos(2 * theta)), 2) + pow(sum({w} * sin(2 * theta)), 2)) / nullif(sum({w}), 0)"


def op(w):
    return _OP.format(w=f"({w})")


@query("agg14", rounded_sql("regions", "img, n", f"""
SELECT img, count(*) AS n, avg(area) AS area_mean, stddev_pop(area) / avg(area) AS area_cv, avg(sqrt(4 * area / pi())) AS eqd_mean,
 sum(area * sqrt(4 * area / pi())) / sum(area) AS eqd_wmean, avg(asp) AS asp_mean, sum(asp * area) / sum(area) AS asp_wmean,
 {op('area')} AS ori_R, coalesce({op('area * (asp - 1)')}, 0) AS ori_Rel, {op('area')} * (sum(asp * area) / sum(area) - 1) AS elong_align,
 median(area) AS area_med, median(asp) AS asp_med FROM regions GROUP BY img"""))
def agg14(spark, sf):
    return rounded(U.shape_stats(regions(spark, sf)))


def _al(ph, cond):
    i = f"CASE WHEN {cond} THEN 1e0 ELSE 0e0 END"
    ok = f"sum({i}) >= 3"
    return f"""CASE WHEN {ok} THEN {op(i)} END AS S_n_{ph}, CASE WHEN {ok} THEN {op(i + ' * area') if False else op('(' + i + ') * area')} END AS S_a_{ph},
 CASE WHEN {ok} THEN coalesce({op('(' + i + ') * (1 - 1 / asp)')}, 0) END AS S_e_{ph}"""


@query("agg15", rounded_sql("regions", "img", f"""
SELECT img, {_al('all', 'true')}, {_al('dk', 'grey < 0.91')}, {_al('mx', 'grey >= 0.91')} FROM regions GROUP BY img""", 5))
def agg15(spark, sf):
    return rounded(U.alignment(regions(spark, sf), dark()), 5)


def _frac():
    out = []
    b = "(area >= 10)::INT + (area >= 25)::INT + (area >= 40)::INT"
    for ph, c in (("dk", "grey < 0.91"), ("mx", "grey >= 0.91")):
        for k in range(4):
            out += [f"sum(CASE WHEN {c} AND {b} = {k} THEN area ELSE 0 END) / sum(area) AS a_{ph}_{k}", f"avg(CASE WHEN {c} AND {b} = {k} THEN 1e0 ELSE 0e0 END) AS n_{ph}_{k}"]
    return ", ".join(out)


@query("agg16", rounded_sql("regions", "img", f"SELECT img, {_frac()} FROM regions GROUP BY img"))
def agg16(spark, sf):
    return rounded(U.size_phase_fractions(regions(spark, sf), dark(), [math.log(e) - 1e-9 for e in (10, 25, 40)]))


@query("agg17", rounded_sql("regions", "img", "SELECT img, " + ", ".join(
    f"sum(CASE WHEN {c} THEN area * pow(ln(area) - 3, {p}) ELSE 0 END) / sum(area) + 2e-10 AS s_{ph}_{p}"
    for ph, c in (("dk", "grey < 0.91"), ("mx", "grey >= 0.91")) for p in range(4)) + " FROM regions GROUP BY img"))
def agg17(spark, sf):
    m = U.power_moments(regions(spark, sf), dark(), 3.0)
    # exact ties of small ratios (0.5046875) round alike in both engines once they are no ties
    return rounded(m.select(*[(F.col(c) + 2e-10).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes]))


@query("agg18", rounded_sql("regions", "img", """
SELECT img, pow(sum(area), 2) / sum(area * area) AS neff, ln(pow(sum(area), 2) / sum(area * area) / count(*)) AS log_neff_over_n,
 CASE WHEN count(CASE WHEN grey < 0.91 THEN 1 END) >= 2 THEN pow(sum(CASE WHEN grey < 0.91 THEN area END), 2) / sum(CASE WHEN grey < 0.91 THEN area * area END) ELSE 0 END AS neff_dk,
 CASE WHEN count(CASE WHEN grey >= 0.91 THEN 1 END) >= 2 THEN pow(sum(CASE WHEN grey >= 0.91 THEN area END), 2) / sum(CASE WHEN grey >= 0.91 THEN area * area END) ELSE 0 END AS neff_mx
FROM regions GROUP BY img"""))
def agg18(spark, sf):
    return rounded(U.effective_numbers(regions(spark, sf), dark()))


_INNER = """ni AS (SELECT img, count(CASE WHEN NOT border THEN 1 END) AS ni FROM regions GROUP BY img),
inn AS (SELECT r.*, ln(area) AS la FROM regions r JOIN ni USING (img) WHERE NOT border OR ni < 5)"""


@query("agg19", rounded_sql("regions", "img", f"""
WITH {_INNER},
w AS (SELECT img, 0.5 * ln(sum(area) / sum(CASE WHEN border THEN 0.5 ELSE 1 END)) AS cnt_jeff, 0.5 * ln(sum(area) / count(*)) AS cnt_raw,
  0.5 * ln(sum(area * area) / sum(area)) AS area_w FROM regions GROUP BY img),
q AS (SELECT img, quantile_cont(la, [0.1, 0.2, 0.5, 0.8, 0.9]) AS q, quantile_cont(area, [0.1, 0.9]) AS qa FROM inn GROUP BY img),
t AS (SELECT img, 0.5 * any_value(q[3]) AS med, 0.5 * avg(CASE WHEN la >= q[1] AND la <= q[5] THEN la END) AS trim10,
  0.5 * avg(CASE WHEN la >= q[2] AND la <= q[4] THEN la END) AS trim20, 0.5 * ln(avg(CASE WHEN area >= qa[1] AND area <= qa[2] THEN area END)) AS trimA10,
  0.5 * ln(avg(area)) AS num_mean FROM inn JOIN q USING (img) GROUP BY img)
SELECT * FROM w JOIN t USING (img)"""))
def agg19(spark, sf):
    return rounded(U.size_estimators(regions(spark, sf)))


@query("agg20", rounded_sql("regions", "img", """
WITH o AS (SELECT *, sum(area) OVER w / sum(area) OVER (PARTITION BY img) AS cs, row_number() OVER (PARTITION BY img ORDER BY area DESC, okey, line, price, cx) AS rn
  FROM regions WINDOW w AS (PARTITION BY img ORDER BY area DESC, okey, line, price, cx ROWS UNBOUNDED PRECEDING)),
k AS (SELECT img, 0.5 * ln(sum(area) / sum(CASE WHEN border THEN 0.5 ELSE 1 END)) AS cnt_ex FROM o WHERE rn > 1 AND cs > 0.1 GROUP BY img HAVING count(*) >= 5)
SELECT i.img, cnt_ex FROM (SELECT DISTINCT img FROM regions) i LEFT JOIN k USING (img)"""))
def agg20(spark, sf):
    return rounded(U.density_without_largest(regions(spark, sf), 0.1, TIE))


@query("agg21", rounded_sql("regions", "img", f"""
WITH {_INNER},
b AS (SELECT img, stddev_pop(la) AS sd, skewness(la) / (sqrt(count(*) * (count(*) - 1e0)) / (count(*) - 2)) AS skew, stddev_pop(area) / avg(area) AS cv,
  quantile_cont(la, 0.75) - quantile_cont(la, 0.25) AS iqr, median(area) AS med FROM inn GROUP BY img),
o AS (SELECT img, area, row_number() OVER (PARTITION BY img ORDER BY area) AS i, count(*) OVER (PARTITION BY img) AS n FROM inn),
g AS (SELECT img, sum((2 * i - n - 1) * area) / (any_value(n) * sum(area)) AS gini,
  sum(CASE WHEN i > n - greatest(1, round_even(0.1 * n, 0)) THEN area ELSE 0 END) / sum(area) AS top10_share FROM o GROUP BY img),
s AS (SELECT img, sqrt(greatest(0, sum(area * ln(area) ** 2) / sum(area) - pow(sum(area * ln(area)) / sum(area), 2))) AS sd_aw,
  sum(CASE WHEN area > 2 * med THEN area ELSE 0 END) / sum(area) AS share_gt2med, sum(CASE WHEN area > 4 * med THEN area ELSE 0 END) / sum(area) AS share_gt4med
  FROM regions JOIN b USING (img) GROUP BY img)
SELECT img, sd, skew, cv, iqr, gini, top10_share, sd_aw, share_gt2med, share_gt4med FROM b JOIN g USING (img) JOIN s USING (img)"""))
def agg21(spark, sf):
    return rounded(U.width_stats(regions(spark, sf)))


@query("agg22", rounded_sql("regions", "img", """
WITH m AS (SELECT img, ln(area) AS la FROM regions), s AS (SELECT img, count(*) AS n, skewness(la) / (sqrt(count(*) * (count(*) - 1e0)) / (count(*) - 2)) AS g, kurtosis_pop(la) AS k FROM m GROUP BY img)
SELECT img, CASE WHEN n > 3 THEN (g * g + 1) / (k + 3.0 * (n - 1) ** 2 / ((n - 2) * (n - 3))) END AS bimod FROM s"""))
def agg22(spark, sf):
    return rounded(U.bimodality(regions(spark, sf).withColumn("la", F.log("area")), "la"))


@query("agg23", rounded_sql("regions", "img", """
WITH md AS (SELECT img, median(area) AS m FROM regions GROUP BY img)
SELECT img, sum(pow(area, -0.25) * area) / sum(area) AS hp_area, avg(pow(area, -0.25)) AS hp_num, pow(avg(area), -0.25) AS hp_of_mean,
 sum(CASE WHEN area < 0.25 * m THEN area ELSE 0 END) / sum(area) AS small_frac, sum(CASE WHEN area > 4 * m THEN area ELSE 0 END) / sum(area) AS big_frac,
 CASE WHEN count(CASE WHEN grey < 0.91 THEN 1 END) >= 2 AND count(CASE WHEN grey >= 0.91 THEN 1 END) >= 2
  THEN ln(avg(CASE WHEN grey < 0.91 THEN area END) / avg(CASE WHEN grey >= 0.91 THEN area END)) END AS size_ratio,
 sum(pow(area, -0.25) * area) / sum(area) / pow(avg(area), -0.25) AS hp_excess FROM regions JOIN md USING (img) GROUP BY img"""))
def agg23(spark, sf):
    return rounded(U.inverse_root_stats(regions(spark, sf), dark()))


@query("agg24", rounded_sql("regions", "img, N_all, N_in, N_bd, N_dark_in, N_mat_in", f"""
WITH d AS (SELECT *, grey < 0.91 AS dk, sqrt(4 * area / pi()) AS d FROM regions)
SELECT img, count(*) AS N_all, count(CASE WHEN NOT border THEN 1 END) AS N_in, count(CASE WHEN border THEN 1 END) AS N_bd,
 sum(CASE WHEN border THEN 0.5 ELSE 1e0 END) AS N_eff, sum(CASE WHEN dk THEN area ELSE 0 END) / sum(area) AS fd_area, avg(CASE WHEN dk THEN 1e0 ELSE 0e0 END) AS fd_num,
 avg(CASE WHEN NOT border THEN CASE WHEN dk THEN 1e0 ELSE 0e0 END END) AS fd_num_in, avg(area) AS amean_all, avg(CASE WHEN NOT border THEN area END) AS amean_in,
 avg(d) AS d_num_all, avg(CASE WHEN NOT border THEN d END) AS d_num_in, sum(CASE WHEN NOT border THEN d * area END) / sum(CASE WHEN NOT border THEN area END) AS d_aw_in,
 count(CASE WHEN dk AND NOT border THEN 1 END) AS N_dark_in, count(CASE WHEN NOT dk AND NOT border THEN 1 END) AS N_mat_in,
 avg(CASE WHEN dk AND NOT border THEN d END) AS d_dark, avg(CASE WHEN NOT dk AND NOT border THEN d END) AS d_mat,
 coalesce({op('area * (asp - 1)')}, 0) AS S_align FROM d GROUP BY img"""))
def agg24(spark, sf):
    return rounded(U.phase_split_stats(regions(spark, sf), dark()))


@query("agg25", rounded_sql("blocks", "id", """
WITH s AS (SELECT id, avg(meas) AS mean, stddev_pop(meas) AS sd, quantile_cont(meas, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) AS q,
 stddev_pop(meas) FILTER (WHERE "by" % 2 = 0 AND bx % 2 = 0) AS sd4, max(meas) FILTER (WHERE "by" % 2 = 0 AND bx % 2 = 0) - min(meas) FILTER (WHERE "by" % 2 = 0 AND bx % 2 = 0) AS rng4
 FROM blocks GROUP BY id)
SELECT id, mean, sd, q[1] AS q0, q[2] AS q10, q[3] AS q25, q[4] AS q50, q[5] AS q75, q[6] AS q90, q[7] AS q100, sd4, rng4,
 q[7] - mean AS max_m_mean, mean - q[1] AS mean_m_min, q[6] - q[2] AS q90_m_q10 FROM s"""))
def agg25(spark, sf):
    return rounded(B.map_stats(blocks(spark, sf), "meas"))


@query("agg26", rounded_sql("blocks", "id", "SELECT id, avg(exp(0.5 * meas)) AS bd_hp, avg(exp(-0.25 * meas)) AS la_hp FROM blocks GROUP BY id"))
def agg26(spark, sf):
    return rounded(B.nonlinear_means(blocks(spark, sf), "meas", {"bd_hp": 0.5, "la_hp": -0.25}))


@query("agg27", rounded_sql("blocks", "id", """
SELECT id, sum(meas * greatest(ctx, 0.05)) / sum(greatest(ctx, 0.05)) AS wmean, stddev_pop(meas) AS sd, quantile_cont(meas, 0.9) AS q90 FROM blocks GROUP BY id"""))
def agg27(spark, sf):
    return rounded(B.weighted_block_stats(blocks(spark, sf), "meas", F.greatest("ctx", F.lit(0.05))))


@query("agg28", rounded_sql("blocks", "id", """
WITH f AS (SELECT regr_slope(ctx, meas) AS b, regr_intercept(ctx, meas) AS a FROM blocks), p AS (SELECT id, a + b * meas AS p, greatest(ctx, 0.05) AS w FROM blocks, f)
SELECT id, avg(p) AS mil_mean, sum(p * w) / sum(w) AS mil_wmean, quantile_cont(p, 0.1) AS mil_q10, median(p) AS mil_q50, quantile_cont(p, 0.9) AS mil_q90,
 max(p) AS mil_max, min(p) AS mil_min, stddev_pop(p) AS mil_sd FROM p GROUP BY id"""))
def agg28(spark, sf):
    b = blocks(spark, sf)
    fit = b.agg(F.regr_slope("ctx", "meas").alias("b"), F.regr_intercept("ctx", "meas").alias("a")).first()
    p = b.withColumn("p", F.lit(fit["a"]) + fit["b"] * F.col("meas"))
    return rounded(B.pooled_predictions(p, "p", F.greatest("ctx", F.lit(0.05))))


@query("agg29", rounded_sql("blocks", "id, blk", "SELECT id, blk, meas, avg(meas) OVER (PARTITION BY id) AS img_meas FROM blocks"))
def agg29(spark, sf):
    return rounded(B.group_mean_back(blocks(spark, sf).select("id", "blk", "meas"), ["id"], ["meas"]))


@query("agg30", "SELECT vec_id AS id, any_value(label) AS label FROM embeddings GROUP BY vec_id")
def agg30(spark, sf):
    return B.context_value(vectors(spark, sf), ["id"], ["label"])


@query("agg31", rounded_sql("blocks", "id", "SELECT id, " + ", ".join(f"max(CASE WHEN blk = {i} THEN meas END) AS b{i:02d}" for i in range(16)) + " FROM blocks GROUP BY id"))
def agg31(spark, sf):
    return rounded(B.block_matrix(blocks(spark, sf), "meas", 16))


@query("agg32", rounded_sql("vectors", "id, cblk", """
WITH p AS (SELECT id, CAST(dim % 8 AS INTEGER) AS ch, stddev_pop(v) AS s, max(v) - min(v) AS r, max(v) AS hi, min(v) AS lo FROM vectors GROUP BY 1, 2)
SELECT id, CAST(ch // 4 AS INTEGER) AS cblk, avg(s) AS std, avg(r) AS "range", avg(hi) AS max, avg(lo) AS min FROM p GROUP BY 1, 2"""))
def agg32(spark, sf):
    return rounded(B.cell_vector_stats(vectors(spark, sf), 8, 4))


@query("agg33", rounded_sql("vectors", "id, ch", "SELECT id, CAST(dim % 16 AS INTEGER) AS ch, avg(v) AS v FROM vectors GROUP BY 1, 2"))
def agg33(spark, sf):
    return rounded(B.view_average(vectors(spark, sf), 16))


@query("agg34", rounded_sql("pixels", "img", """
SELECT img, avg(v) FILTER (WHERE least(y, x, 7 - y, 7 - x) = 0) AS c_ring0, avg(v) FILTER (WHERE least(y, x, 7 - y, 7 - x) > 0) AS c_inner, stddev_pop(v) AS c_sd FROM pixels GROUP BY img"""))
def agg34(spark, sf):
    return rounded(B.ring_stats(pixels(spark, sf), 8))


@query("agg35", rounded_sql("mask labelmap", "img", """
WITH fr AS (SELECT img, (y // 2) * 4 + x // 2 AS w, avg(m::INT) AS fr FROM mask GROUP BY 1, 2),
u AS (SELECT img, lab, avg(y) AS cy, avg(x) AS cx FROM labelmap GROUP BY img, lab),
c AS (SELECT img, CAST(floor(cy / 2) * 4 + floor(cx / 2) AS BIGINT) AS w, count(*) AS c FROM u GROUP BY 1, 2),
j AS (SELECT img, fr, coalesce(c, 0) AS c FROM fr LEFT JOIN c USING (img, w))
SELECT img, var_pop(fr) / greatest(avg(fr) * (1 - avg(fr)) * avg(1e0 / greatest(c, 1)), 1e-6) AS disp, stddev_pop(fr) AS cell_sd, stddev_pop(c) / greatest(avg(c), 1e-6) AS count_cv FROM j GROUP BY img"""))
def agg35(spark, sf):
    return rounded(B.window_dispersion(mask(spark, sf), U.region_table(labelmap(spark, sf)), 8, 4))


@query("agg36", rounded_sql("regions", "img", """
WITH c AS (SELECT img, a, b, count(area) AS n FROM (SELECT DISTINCT img, a, b FROM regions, (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b)) g
  LEFT JOIN regions r USING (img) WHERE floor(cy / 64) = a AND floor(cx / 64) = b GROUP BY img, a, b)
SELECT img, sqrt(greatest(0, sum(n * n) / 16.0 - pow(sum(n) / 16.0, 2))) / (sum(n) / 16.0) AS cnt_cv FROM c GROUP BY img"""))
def agg36(spark, sf):
    return rounded(U.count_cv(regions(spark, sf), 4, 256.0))


@query("agg36_fd", rounded_sql("mask", "img", """
SELECT img, stddev_pop(fr) AS fd_blk_sd FROM (SELECT img, (y // 2) * 4 + x // 2 AS w, avg(m::INT) AS fr FROM mask GROUP BY 1, 2) GROUP BY img"""))
def agg36_fd(spark, sf):
    return rounded(B.block_fraction_sd(mask(spark, sf), 8, 4))


@query("agg37", rounded_sql("labelled", "img", """
WITH m AS (SELECT img, avg(ln(area)) AS m, count(*) AS n, var_pop(ln(area)) AS v FROM labelled GROUP BY img),
z AS (SELECT l.img, label, cy, cx, ln(area) - m AS z FROM labelled l JOIN m USING (img) WHERE n >= 15 AND v > 0),
p AS (SELECT a.img, count(*) AS pairs, sum(a.z * b.z) AS s FROM z a JOIN z b ON a.img = b.img AND a.label < b.label AND (a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2 <= 48 * 48 GROUP BY a.img)
SELECT m.img, s / pairs / v AS moran FROM m LEFT JOIN p USING (img)"""))
def agg37(spark, sf):
    return rounded(U.morans_i(regions(spark, sf).withColumn("la", F.log("area")), "la", 48.0))


@query("agg38", rounded_sql("regions", "img", """
WITH l AS (SELECT img, c, sum(w * la) / sum(w) AS la FROM (
 SELECT img, c, ln(area) AS la, exp(-((cy - yc) ** 2 + (cx - xc) ** 2) / 8192) * area AS w
 FROM regions, (SELECT i AS c, 32 + 64 * (i // 4) AS yc, 32 + 64 * (i % 4) AS xc FROM (SELECT unnest(range(0, 16)) AS i))) GROUP BY img, c),
g AS (SELECT img, stddev_pop(la) AS sd, max(la) AS hi, min(la) AS lo FROM l GROUP BY img),
o AS (SELECT img, stddev_pop(ln(area)) AS own, sum(area * ln(area)) / sum(area) AS w FROM regions GROUP BY img)
SELECT img, sd AS lf_sd, hi - lo AS lf_rng, hi AS lf_max, lo AS lf_min, sd / greatest(own, 1e-6) AS lf_sd_rel, hi - w AS lf_max_minus_w FROM g JOIN o USING (img)"""))
def agg38(spark, sf):
    return rounded(U.local_field_stats(regions(spark, sf), GRID16, 64.0))


@query("agg51", rounded_sql("regions", "img", "SELECT img, " + ", ".join(
    f"sum(CASE WHEN grey < {t} THEN area ELSE 0 END) / sum(area) AS fd{int(round(t * 100))}, avg(CASE WHEN grey < {t} THEN 1e0 ELSE 0e0 END) AS nd{int(round(t * 100))}" for t in (0.91, 0.7, 0.5)) + """,
 coalesce(avg(CASE WHEN grey < 0.91 THEN area END), 0) AS dk_area_mean, coalesce(avg(CASE WHEN grey >= 0.91 THEN area END), 0) AS mx_area_mean,
 CASE WHEN count(CASE WHEN grey < 0.91 THEN 1 END) >= 2 THEN sum(CASE WHEN grey < 0.91 THEN area * grey END) / sum(CASE WHEN grey < 0.91 THEN area END) END AS dk_level FROM regions GROUP BY img"""))
def agg51(spark, sf):
    return rounded(U.flagged_fractions(regions(spark, sf), "grey", [0.91, 0.7, 0.5]))


@query("agg52", rounded_sql("labelmap", "img", """
WITH adj AS (SELECT a.img, a.lab AS l1, b.lab AS l2 FROM labelmap a JOIN labelmap b
  ON a.img = b.img AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))),
reg AS (SELECT img, lab, avg(v) < 0 AS dk FROM labelmap GROUP BY img, lab),
e AS (SELECT DISTINCT img, least(l1, l2) AS a, greatest(l1, l2) AS b FROM adj WHERE l1 <> l2),
pe AS (SELECT e.img, count(*) AS n, avg((p.dk AND q.dk)::INT) AS bo, avg((p.dk <> q.dk)::INT) AS one FROM e JOIN reg p ON p.img = e.img AND p.lab = e.a JOIN reg q ON q.img = e.img AND q.lab = e.b GROUP BY e.img),
pr AS (SELECT img, count(*) AS n, avg(dk::INT) AS p FROM reg GROUP BY img)
SELECT pr.img, 2 * coalesce(pe.n, 0) / pr.n AS nb_mean, coalesce(bo, 0) AS dd_contact, coalesce(one, 0) AS dm_contact, coalesce(bo, 0) - p * p AS dd_excess FROM pr LEFT JOIN pe USING (img)"""))
def agg52(spark, sf):
    lm = labelmap(spark, sf)
    return rounded(U.contact_stats(lm, J.adjacency(lm), 0.0))


@query("agg54", rounded_sql("regions", "img", f"""
WITH t AS (SELECT img, 0.5 * atan2(sum(area * sin(2 * theta)), sum(area * cos(2 * theta))) AS th0, {op('area')} AS align_R FROM regions GROUP BY img),
d AS (SELECT r.*, align_R, ln(greatest(1, least(50, asp))) AS la, cos(2 * (theta - th0)) AS c2, sin(2 * (theta - th0)) AS s2 FROM regions r JOIN t USING (img)),
s AS (SELECT img, avg(cosh(la) + sinh(la) * c2) AS txx, avg(cosh(la) - sinh(la) * c2) AS tyy, avg(sinh(la) * s2) AS txy, any_value(align_R) AS align_R,
 sum(c2 * area) / sum(area) AS align_wmean, avg(la) AS logasp_mean, sum(la * area) / sum(area) AS logasp_wmean FROM d GROUP BY img),
e AS (SELECT *, (txx + tyy) / 2 AS h, sqrt(pow((txx - tyy) / 2, 2) + txy * txy) AS dd FROM s)
SELECT img, 0.5 * ln((h + dd) / greatest(h - dd, 1e-6)) AS strain, align_R, align_wmean, logasp_mean, logasp_wmean FROM e"""))
def agg54(spark, sf):
    return rounded(U.shape_tensor(regions(spark, sf)))


@query("agg55", rounded_sql("regions", "img, big0_dark, big0_border, big1_dark, big1_border, big2_dark, big2_border", """
WITH r AS (SELECT *, sum(area) OVER (PARTITION BY img) AS t, row_number() OVER (PARTITION BY img ORDER BY area DESC, okey, line, price, cx) AS rn FROM regions)
SELECT img, """ + ", ".join(f"""max(CASE WHEN rn = {j + 1} THEN area / t END) AS big{j}_share, max(CASE WHEN rn = {j + 1} THEN CAST(grey < 0.91 AS INTEGER) END) AS big{j}_dark,
 max(CASE WHEN rn = {j + 1} THEN CAST(border AS INTEGER) END) AS big{j}_border, max(CASE WHEN rn = {j + 1} THEN asp END) AS big{j}_asp""" for j in range(3)) + " FROM r WHERE rn <= 3 GROUP BY img"))
def agg55(spark, sf):
    return rounded(U.largest_units(regions(spark, sf), dark(), TIE))
