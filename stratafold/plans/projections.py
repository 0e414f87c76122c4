"""Projection queries."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import columns as C
from ..operators import folds as FO
from .fixtures import train_rows, files, folds, members, rows, samples, table, with_ctes
from .registry import query

CUT = "(SELECT quantile_cont({c}, {p}) FROM rows_ WHERE fold <> 4)"


def cut(c, p):
    return CUT.format(c=c, p=p)


@query("prj01", with_ctes("samples", "SELECT id, x1, x2, x3, q1 FROM samples"))
def prj01(spark, sf):
    return C.select_columns(samples(spark, sf), keep="shape", drop="^q2$")


@query("prj02", with_ctes("samples", "SELECT id, x1 AS raw_x1, q1 AS raw_q1 FROM samples"))
def prj02(spark, sf):
    return C.copy_columns(samples(spark, sf), ["x1", "q1"], "raw_")


@query("prj03", with_ctes("samples", """
SELECT id, CASE WHEN x2 > 0 THEN x1 / x2 END AS ratio, CASE WHEN x3 > 0 THEN x1 * 0 + x3 END AS safe FROM samples"""))
def prj03(spark, sf):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    d = samples(spark, sf).select("id", F.when(F.col("x2") > 0, F.col("x1") / F.col("x2")).otherwise(inf).alias("ratio"),
                                  F.when(F.col("x3") > 0, F.col("x3")).otherwise(nan).alias("safe"))
    return C.nonfinite_to_null(d)


_STD = """
WITH k AS (SELECT DISTINCT fold FROM rows_),
med AS (SELECT k.fold, median(x1n) AS m1, median(x5n) AS m5 FROM k JOIN rows_ r ON r.fold <> k.fold GROUP BY k.fold),
st AS (SELECT m.fold, m1, m5, avg(coalesce(x1n, m1)) AS u1, stddev_samp(coalesce(x1n, m1)) AS s1,
  avg(coalesce(x5n, m5)) AS u5, stddev_samp(coalesce(x5n, m5)) AS s5
  FROM med m JOIN rows_ r ON r.fold <> m.fold GROUP BY m.fold, m1, m5)
"""


@query("prj04", with_ctes("rows_", _STD + """
SELECT id, fold, round((coalesce(x1n, m1) - u1) / s1, 6) AS z_x1n, round((coalesce(x5n, m5) - u5) / s5, 6) AS z_x5n
FROM rows_ JOIN st USING (fold)"""))
def prj04(spark, sf):
    d = C.standardise_in_fold(rows(spark, sf), ["x1n", "x5n"])
    return d.select("id", "fold", F.round("z_x1n", 6).alias("z_x1n"), F.round("z_x5n", 6).alias("z_x5n"))


@query("prj05", with_ctes("rows_", _STD + """
SELECT id, round(2.0 * (coalesce(x1n, m1) - u1) / s1, 6) AS z_x1n, round(0.5 * (coalesce(x5n, m5) - u5) / s5, 6) AS z_x5n
FROM rows_ JOIN st USING (fold)"""))
def prj05(spark, sf):
    d = C.scale_columns(C.standardise_in_fold(rows(spark, sf), ["x1n", "x5n"]), {"z_x1n": 2.0, "z_x5n": 0.5})
    return d.select("id", F.round("z_x1n", 6).alias("z_x1n"), F.round("z_x5n", 6).alias("z_x5n"))


@query("prj06", with_ctes("rows_", f"""
SELECT id, CASE WHEN q1 > {cut('q1', '1/3')} AND q1 <= {cut('q1', '2/3')} THEN x1 END AS n2_x1,
  CASE WHEN q1 > {cut('q1', '1/3')} AND q1 <= {cut('q1', '2/3')} THEN x2 END AS n2_x2 FROM rows_"""))
def prj06(spark, sf):
    return C.band_columns(rows(spark, sf), ["x1", "x2"], "q1", train_rows(), 1 / 3, 2 / 3, "n2_")


@query("prj07", with_ctes("rows_", f"""
WITH c AS (SELECT {cut('q1', '1/3')} AS c1, {cut('q1', '2/3')} AS c2),
t AS (SELECT id, x1, x2, greatest(0.0, least(1.0, (q1 - c1) / (c2 - c1))) AS t FROM rows_, c)
SELECT id, round(x1 * t, 6) AS rmp_x1, round(x2 * t, 6) AS rmp_x2, round(t, 6) AS rmp_t FROM t"""))
def prj07(spark, sf):
    d = C.ramp_interaction(rows(spark, sf), ["x1", "x2"], "q1", train_rows())
    return d.select("id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("prj08", with_ctes("rows_", """
WITH c AS (SELECT avg(q1) AS m, stddev_samp(q1) AS s FROM rows_ WHERE fold <> 4)
SELECT id, round(x1 * (q1 - m) / s, 6) AS zi_x1, round((q1 - m) / s, 6) AS zi_t FROM rows_, c"""))
def prj08(spark, sf):
    d = C.z_interaction(rows(spark, sf), ["x1"], "q1", train_rows())
    return d.select("id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("prj09", with_ctes("samples", """
SELECT id, greatest(0.0, least(1.0, (q1 / 30 - 0.7) / 0.4)) AS gate,
  greatest(0.0, least(1.0, (q1 / 30 - 0.7) / 0.4)) * x1 AS g_x1,
  greatest(0.0, least(1.0, (q1 / 30 - 0.7) / 0.4)) * x2 AS g_x2 FROM samples"""))
def prj09(spark, sf):
    d = samples(spark, sf).withColumn("snr", F.col("q1") / 30)
    return C.soft_gate(d, ["x1", "x2"], "snr", 0.7, 0.4)


@query("prj10", with_ctes("rows_", """
SELECT id, CASE WHEN q1 < 20 THEN 1e0 ELSE 0e0 END AS gate, CASE WHEN q1 < 20 THEN x2 ELSE 0 END AS gate_h,
  CASE WHEN q1 < 20 THEN round(pow(x4, 0.25), 6) ELSE 0 END AS gate_n, CASE WHEN q1 < 20 THEN x2 END AS tree_h FROM rows_"""))
def prj10(spark, sf):
    r = rows(spark, sf)
    gate = r.where("q1 < 20").select("id", "x2", "x4")
    lin = C.gated_member_columns(r.select("id"), gate, "x2", "x4")
    tree = C.gated_member_columns(r.select("id"), gate, "x2", "x4", tree=True).select("id", F.col("gate_h").alias("tree_h"))
    return lin.join(tree, "id").withColumn("gate_n", F.round("gate_n", 6))


@query("prj11", with_ctes("rows_", f"""
WITH c AS (SELECT {cut('q1', '1/3')} AS c1, {cut('q1', '2/3')} AS c2),
t AS (SELECT id, x1, x2, CAST((q1 > c1)::INT + (q1 > c2)::INT AS INTEGER) AS grp FROM rows_, c)
SELECT id, grp, x1, x2, CASE WHEN grp = 1 THEN x1 END AS x1_own1, CASE WHEN grp = 1 THEN x2 END AS x2_own1,
 CASE WHEN grp = 2 THEN x1 END AS x1_own2, CASE WHEN grp = 2 THEN x2 END AS x2_own2 FROM t"""))
def prj11(spark, sf):
    return C.group_columns(rows(spark, sf), ["x1", "x2"], "q1", train_rows(), [1 / 3, 2 / 3])


@query("prj12", with_ctes("rows_", "SELECT id, g FROM rows_"))
def prj12(spark, sf):
    return samples(spark, sf).select("id", C.stratum("q1", "x2", 20.0, 26.0, 0.05).alias("g"))


@query("prj13", with_ctes("rows_", f"SELECT id, ln(x4) > ln({cut('x4', '0.5')}) AND q1 > {cut('q1', '0.5')} AS in_cell FROM rows_"))
def prj13(spark, sf):
    r = rows(spark, sf)
    return r.select("id", C.above_train_medians(r, ["x4", "q1"], train_rows()).alias("in_cell"))


@query("prj14", with_ctes("samples", """
SELECT id, CAST(b AS INTEGER) AS band, q1 >= lo - 1.5 AND q1 < hi + 1.5 AS fit, q1 >= lo AND q1 < hi AS apply
FROM samples, (VALUES (0, '-infinity'::DOUBLE, 20.0), (1, 20.0, 26.0), (2, 26.0, 'infinity'::DOUBLE)) t(b, lo, hi)"""))
def prj14(spark, sf):
    masks = C.band_masks("q1", [20.0, 26.0], 1.5)
    per = F.array(*[F.struct(F.lit(b).alias("band"), f.alias("fit"), a.alias("apply")) for b, (f, a) in enumerate(masks)])
    return samples(spark, sf).select("id", F.inline(per))


@query("prj15", with_ctes("samples", """
SELECT id, round(sign(y - 150) * ln(1 + abs(y - 150)), 6) AS sl_d, round(sign(y - 150) * sqrt(abs(y - 150)), 6) AS ss_d FROM samples"""))
def prj15(spark, sf):
    d = C.signed_transforms(samples(spark, sf).withColumn("d", F.col("y") - 150), ["d"])
    return d.select("id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("prj16", with_ctes("samples", "SELECT id, round(ln(x1), 6) AS x1, round(x2, 6) AS x2, round(ln(q1), 6) AS q1 FROM samples"))
def prj16(spark, sf):
    d = C.log_if_positive(samples(spark, sf).select("id", "x1", "x2", "q1"), ["x1", "x2", "q1"])
    return d.select("id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("prj17", with_ctes("members", """
WITH o AS (SELECT id, fold, y - p1 AS o FROM members), m AS (SELECT max(abs(o)) AS m FROM o WHERE fold <> 4)
SELECT id, round(greatest(-m, least(m, o * 1.5)), 6) AS o FROM o, m"""))
def prj17(spark, sf):
    d = members(spark, sf).select("id", "fold", (F.col("y") - F.col("p1")).alias("o"), ((F.col("y") - F.col("p1")) * 1.5).alias("o2"))
    m = d.where(train_rows()).agg(F.max(F.abs("o")).alias("m")).first()["m"]
    return d.select("id", F.round(S.clip("o2", -m, m), 6).alias("o"))


@query("prj18", with_ctes("files", "SELECT id, CASE WHEN g = 'clean' THEN f3 ELSE f2 END AS pred FROM files"))
def prj18(spark, sf):
    f = files(spark, sf)
    changed = f.where("g = 'clean'").select("id", F.col("f3").alias("pred"))
    return C.replace_rows(f.select("id", F.col("f2").alias("pred")), changed)


@query("prj19", with_ctes("files", "SELECT id, round(f1 + CASE WHEN g = 'clean' THEN 0.8 ELSE 0.2 END * (f2 - f1), 6) AS pred FROM files"))
def prj19(spark, sf):
    share = S.by_value("g", {"clean": 0.8}, 0.2)
    return files(spark, sf).select("id", F.round(C.convex_mix("f1", "f2", share), 6).alias("pred"))


@query("prj20", """
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'TRAIN_' ELSE 'TEST_' END || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key FROM orders)
SELECT key, split_part(key, '_', 1) AS prefix, CAST(regexp_extract(key, '(\\d+)$', 1) AS BIGINT) AS num,
 CAST(regexp_replace(key, '\\D', '', 'g') AS BIGINT) AS seed, starts_with(key, 'TRAIN') AS is_train FROM k""")
def prj20(spark, sf):
    pre = F.when(F.col("o_orderstatus") == "F", "TRAIN_").otherwise("TEST_")
    d = table(spark, sf, "orders").select(F.concat(pre, F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("key"))
    return d.select("key", *C.key_parts("key"))


DESIGNS = {
    "lin": [lambda: F.lit(1.0), lambda: F.col("x1"), lambda: F.col("x4")],
    "cross": [lambda: F.lit(1.0), lambda: F.col("x1") * F.col("x2"), lambda: F.sqrt("x4")],
}


@query("prj21", with_ctes("samples", "SELECT id, 1e0 AS d0, x1 * x2 AS d1, round(sqrt(x4), 6) AS d2 FROM samples"))
def prj21(spark, sf):
    return C.design(samples(spark, sf), DESIGNS, "cross").withColumn("d2", F.round("d2", 6))


# ---------------------------------------------------------------- folds
@query("win01", with_ctes("folds", "SELECT id, bin, fold FROM folds"))
def win01(spark, sf):
    return folds(spark, sf).select("id", "bin", "fold")


@query("win02", with_ctes("rows_", """
WITH s AS (SELECT id, g, split FROM rows_, (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS split)),
n AS (SELECT *, row_number() OVER (PARTITION BY split, g ORDER BY md5('7:' || split || ':' || id), id) AS rn,
 CAST(floor(CAST('0x' || substr(md5('7:' || split || ':' || g), 1, 12) AS BIGINT) / 281474976710656e0 * 5) AS BIGINT) AS shift FROM s)
SELECT id, g, split, CAST((rn + shift) % 5 AS INTEGER) AS fold FROM n"""))
def win02(spark, sf):
    return FO.stratified_resplits(rows(spark, sf).select("id", "g"), "id", "g", 4, seed=7)


@query("win03", """
WITH s AS (SELECT user_id, CAST((row_number() OVER (ORDER BY user_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events))
SELECT event_id AS id, user_id AS src, fold FROM events JOIN s USING (user_id)""")
def win03(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("src"))
    return FO.group_folds(e, "src").select("id", "src", "fold")
