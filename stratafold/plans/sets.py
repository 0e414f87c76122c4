"""Set, sort and scalar-function queries."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ranking as R
from ..operators import sets as T
from .fixtures import files, rows, samples, seq, table, variants, vectors, with_ctes
from .registry import query


@query("set01", with_ctes("variants pixels", """
SELECT id, var, round(meas, 6) AS meas, 'degraded' AS src FROM variants
UNION ALL SELECT img, -1, round(avg(v), 6), 'identity' FROM pixels GROUP BY img"""))
def set01(spark, sf):
    ident = vectors(spark, sf).groupBy("id").agg(F.avg("v").alias("meas")).withColumn("var", F.lit(-1))
    d = T.union_tagged({"degraded": variants(spark, sf), "identity": ident})
    return d.withColumn("meas", F.round("meas", 6))


@query("set02", with_ctes("files", """
SELECT id, CASE WHEN g = 'clean' THEN f3 WHEN g = 'G1hi' THEN f1 ELSE f2 END AS pred,
 CAST(CASE WHEN g = 'clean' AND f3 <> f2 THEN 1 WHEN g = 'G1hi' AND f1 <> f2 THEN 1 ELSE 0 END AS INTEGER) AS n_changes FROM files"""))
def set02(spark, sf):
    f = files(spark, sf)
    base = f.select("id", F.col("f2").alias("pred"))
    a = f.where("g = 'clean'").select("id", F.col("f3").alias("pred"))
    b = f.where("g = 'G1hi'").select("id", F.col("f1").alias("pred"))
    return T.disjoint_changes(base, [a, b])


@query("set03", with_ctes("files", "SELECT id, round(f0 + (f1 - f0) + (f2 - f0), 6) AS pred FROM files"))
def set03(spark, sf):
    return T.additive_changes(files(spark, sf), "f0", ["f1", "f2"]).withColumn("pred", F.round("pred", 6))


@query("set04", """
SELECT o_orderkey AS id, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def set04(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return T.key_difference(o, li, "id")


@query("set05", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def set05(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return T.keep_last(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("set06", with_ctes("samples", "SELECT id, x1, x2, q1 FROM samples"))
def set06(spark, sf):
    s = samples(spark, sf)
    return T.drop_duplicate_columns([s.select("id", "x1", "x2"), s.select("id", "x2", "q1")])


# ---------------------------------------------------------------- sorts
@query("srt01", with_ctes("samples", "SELECT id, round(y - 150, 6) AS d FROM samples ORDER BY abs(y - 150) DESC, id LIMIT 20"))
def srt01(spark, sf):
    return R.top_by_abs(samples(spark, sf).select("id", F.round(F.col("y") - 150, 6).alias("d")), "d", 20, "id")


@query("srt02", with_ctes("rows_", """
WITH c AS (SELECT g, fold, avg(y) AS score, CASE g WHEN 'clean' THEN 0 WHEN 'LV' THEN 1 ELSE 2 END AS cls, count(*) AS n FROM rows_ GROUP BY g, fold)
SELECT g, fold, CAST(row_number() OVER (ORDER BY cls, round(score / 10), n DESC, g, fold) AS BIGINT) AS rnk FROM c"""))
def srt02(spark, sf):
    from ..functions.ranks import row_numbers

    c = rows(spark, sf).groupBy("g", "fold").agg(F.avg("y").alias("score"), F.count(F.lit(1)).alias("n"))
    c = c.withColumns({"cls": S.by_value("g", {"clean": 0, "LV": 1}, 2), "s10": F.round(F.col("score") / 10)})
    return row_numbers(c, [], ["cls", "s10", -F.col("n"), "g", "fold"], "rnk").select("g", "fold", "rnk")


@query("srt03", with_ctes("files", """
WITH s AS (SELECT m, ord, avg(sq) AS score FROM (SELECT unnest([0, 1, 2, 3]) AS ord, unnest(['f0', 'f1', 'f2', 'f3']) AS m,
 unnest([(f0 - y) ** 2, (f1 - y) ** 2, (f2 - y) ** 2, (f3 - y) ** 2]) AS sq FROM files) GROUP BY m, ord),
k AS (SELECT m FROM s ORDER BY score, ord LIMIT 2)
SELECT id, round((CASE WHEN 'f0' IN (SELECT m FROM k) THEN f0 ELSE 0 END + CASE WHEN 'f1' IN (SELECT m FROM k) THEN f1 ELSE 0 END
 + CASE WHEN 'f2' IN (SELECT m FROM k) THEN f2 ELSE 0 END + CASE WHEN 'f3' IN (SELECT m FROM k) THEN f3 ELSE 0 END) / 2, 6) AS pred FROM files"""))
def srt03(spark, sf):
    f = files(spark, sf)
    names = ["f0", "f1", "f2", "f3"]
    score = f.agg(*[F.avg(F.pow(F.col(n) - F.col("y"), 2)).alias(n) for n in names]).first()
    best = sorted(names, key=lambda n: (score[n], names.index(n)))[:2]
    return f.select("id", F.round((F.col(best[0]) + F.col(best[1])) / 2, 6).alias("pred"))


@query("srt04", with_ctes("members", """
WITH d AS (SELECT id, g, round(p1 - y, 6) AS d FROM members)
SELECT g, 'over' AS side, id, d, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d DESC, id) AS rn FROM d) WHERE rn <= 5
UNION ALL SELECT g, 'under', id, d, CAST(rn AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, id) AS rn FROM d) WHERE rn <= 5"""))
def srt04(spark, sf):
    from .fixtures import members

    d = members(spark, sf).select("g", "id", F.round(F.col("p1") - F.col("y"), 6).alias("d"))
    over = R.top_per_group(d, ["g"], [F.desc("d"), F.asc("id")], 5).withColumn("side", F.lit("over"))
    return over.unionByName(R.top_per_group(d, ["g"], [F.asc("d"), F.asc("id")], 5).withColumn("side", F.lit("under")))


@query("srt05", with_ctes("samples", """
WITH r AS (SELECT id, q1, row_number() OVER (ORDER BY q1, id) AS rn, count(*) OVER () AS n FROM samples)
SELECT id, q1 FROM r WHERE rn IN (SELECT round_even(i * (n - 1) / 11.0, 0) + 1 FROM (SELECT unnest(range(0, 12)) AS i), (SELECT count(*) AS n FROM samples))"""))
def srt05(spark, sf):
    return R.evenly_spaced(samples(spark, sf).select("id", "q1"), "q1", "id", 12).select("id", "q1")


# ---------------------------------------------------------------- scalar functions
@query("fun01", with_ctes("samples", """
SELECT id, round(ln(x1), 6) AS a_log, round(ln(1 + x2), 6) AS a_log1p, round(exp(-x2), 6) AS a_exp, round(sqrt(y), 6) AS a_sqrt,
 round(pow(x1, -0.5), 6) AS a_pow, greatest(10.0, least(40.0, q1)) AS a_clip, sign(y - 150) AS a_sign, round(sqrt(x1 * x1 + x5 * x5), 6) AS a_hypot,
 round(atan2(x1, x5), 6) AS a_atan, round(cos(x1), 6) AS a_cos, CAST(floor(x1 / 7) AS BIGINT) AS a_div, x1 - 7 * floor(x1 / 7) AS a_mod FROM samples"""))
def fun01(spark, sf):
    x1, x5 = F.col("x1"), F.col("x5")
    return samples(spark, sf).select(
        "id", F.round(F.log("x1"), 6).alias("a_log"), F.round(F.log1p("x2"), 6).alias("a_log1p"), F.round(F.exp(-F.col("x2")), 6).alias("a_exp"),
        F.round(F.sqrt("y"), 6).alias("a_sqrt"), F.round(F.pow(x1, F.lit(-0.5)), 6).alias("a_pow"), S.clip("q1", 10.0, 40.0).alias("a_clip"),
        F.signum(F.col("y") - 150).alias("a_sign"), F.round(F.hypot("x1", "x5"), 6).alias("a_hypot"), F.round(F.atan2("x1", "x5"), 6).alias("a_atan"),
        F.round(F.cos("x1"), 6).alias("a_cos"), F.floor(x1 / 7).alias("a_div"), F.pmod(x1, F.lit(7.0)).alias("a_mod"))


@query("fun02", with_ctes("samples", """
WITH s AS (SELECT id, (q1 - 25) / 8 AS z FROM samples), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM s),
p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS pdf FROM t),
u AS (SELECT *, pdf * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t AS u FROM p)
SELECT id, round(pdf, 6) AS pdf, round(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 6) AS cdf FROM u"""))
def fun02(spark, sf):
    z = (F.col("q1") - 25) / 8
    return samples(spark, sf).select("id", F.round(S.norm_pdf(z), 6).alias("pdf"), F.round(S.norm_cdf(z), 6).alias("cdf"))


@query("fun03", """
SELECT p_partkey, starts_with(p_type, 'STANDARD') AS std, substr(p_brand, 7) AS num, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
 split_part(p_type, ' ', 1) AS head, p_brand || '/' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS tag FROM part""")
def fun03(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").startswith("STANDARD").alias("std"), F.expr("substring(p_brand, 7)").alias("num"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.split("p_type", " ")[0].alias("head"),
        F.concat(F.col("p_brand"), F.lit("/"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("tag"))


@query("fun04", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT id, round(list_sum(e) / 64, 6) AS mean, round(sqrt(list_sum(list_transform(e, lambda z: z * z)) / 64 - pow(list_sum(e) / 64, 2)), 6) AS sd,
 round(sqrt(list_sum(list_transform(e, lambda z: z * z))), 6) AS norm, round(e[9], 6) AS s0,
 round(list_sum(list_transform(range(1, 33), lambda i: e[i] * e[i + 32])), 6) AS halves_dot, round(e[64], 6) AS rev0 FROM e""")
def fun04(spark, sf):
    from ..functions import arrays as A

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    half = F.slice("e", 1, 32), F.slice("e", 33, 32)
    return e.select("id", F.round(A.mean("e"), 6).alias("mean"), F.round(A.std("e"), 6).alias("sd"), F.round(A.norm("e"), 6).alias("norm"),
                    F.round(F.slice("e", 9, 8)[0], 6).alias("s0"), F.round(A.dot(*half), 6).alias("halves_dot"),
                    F.round(A.permute("e", list(range(63, -1, -1)))[0], 6).alias("rev0"))


@query("fun05", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1 FROM events")
def fun05(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), (m["k"] + 1).alias("k1"))


@query("fun06", with_ctes("rows_", """
SELECT g, count(x1n) AS n, round(avg(x1n), 6) AS mean, round(quantile_cont(x1n, 0.25), 6) AS q25, round(avg(coalesce(x1n, 0)), 6) AS filled FROM rows_ GROUP BY g"""))
def fun06(spark, sf):
    from ..functions.ranks import quantiles

    r = rows(spark, sf)
    a = r.groupBy("g").agg(F.count("x1n").alias("n"), F.round(F.avg(S.finite("x1n")), 6).alias("mean"), F.round(F.avg(F.coalesce("x1n", F.lit(0.0))), 6).alias("filled"))
    return a.join(quantiles(r, ["g"], "x1n", {"q25": 0.25}).select("g", F.round("q25", 6).alias("q25")), "g")


@query("fun07", """
SELECT l_orderkey AS id, count(*) AS n, CASE WHEN count(*) >= 10 THEN 1.539e0 WHEN count(*) >= 5 THEN 1.163e0 WHEN count(*) = 4 THEN 1.029e0
 WHEN count(*) = 3 THEN 0.846e0 WHEN count(*) = 2 THEN 0.564e0 ELSE 0e0 END AS bias FROM lineitem GROUP BY 1""")
def fun07(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("bias", S.expected_max_bias("n"))
