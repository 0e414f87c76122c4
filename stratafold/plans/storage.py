"""Source, sink and per-entity function queries. Files go to a fresh path in the shared folder."""

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as M
from ..operators.ranking import spearman
from ..session import scratch_path
from ..sources import readers as S
from ..sources import writers as K
from .fixtures import files, members, pixels, rounded, rounded_sql, rows, samples, table, with_ctes
from .registry import query


@query("src01", with_ctes("rows_", "SELECT id, y, fold FROM rows_"))
def src01(spark, sf):
    r, p = rows(spark, sf), scratch_path(spark, "labels")
    r.select("id", "y").write.option("header", True).csv(p + "/y")
    r.select("id", "fold").write.option("header", True).csv(p + "/f")
    return S.read_labels(spark, p + "/y", p + "/f")


@query("src02", with_ctes("rows_", "SELECT id FROM rows_ WHERE fold = 4"))
def src02(spark, sf):
    p = scratch_path(spark, "keys")
    rows(spark, sf).where("fold = 4").select("id", "y").write.option("header", True).csv(p)
    return S.read_keys(spark, p)


@query("src03", with_ctes("samples", "SELECT id, x1, x2, x2 AS f1_x2, q1, x1 AS f2_x1 FROM samples"))
def src03(spark, sf):
    s = samples(spark, sf)
    return J.join_tables([s.select("id", "x1", "x2"), s.select("id", "x2", "q1"), s.select("id", "x1")])


@query("src04", "SELECT l_orderkey, l_quantity FROM lineitem")
def src04(spark, sf):
    return S.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("src06", """
SELECT vec_id AS id, b AS block, round(list_sum(list_transform(embedding[s:e], lambda z: CAST(z AS DOUBLE))) / (e - s + 1), 6) AS mean FROM embeddings,
 (VALUES ('global', 1, 16), ('cells', 17, 64)) t(b, s, e)""")
def src06(spark, sf):
    from ..functions import arrays as A

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    b = S.embedding_blocks(e, "id", "e", [("global", 0, 16), ("cells", 16, 64)])
    return b.select("id", "block", F.round(A.mean("emb"), 6).alias("mean"))


@query("src07", with_ctes("files", """
SELECT 'fold' || fold AS option, round(avg((f3 - y) ** 2 - (f2 - y) ** 2), 4) AS oof_dmse FROM files WHERE fold <> 4 GROUP BY fold"""))
def src07(spark, sf):
    p = scratch_path(spark, "results")
    g = files(spark, sf).groupBy("fold").agg(F.round(F.avg(F.pow(F.col("f3") - F.col("y"), 2) - F.pow(F.col("f2") - F.col("y"), 2)), 4).alias("d"))
    g = g.select(F.concat(F.lit("fold"), "fold").alias("option"), F.when(F.col("fold") == 4, "diagnostic").otherwise("option").alias("kind"),
                 F.struct(F.col("d").alias("oof_dmse")).alias("vs_base"))
    # one file per result, written over several lines as such files are
    g = g.select("option", F.to_json(F.struct("option", "kind", "vs_base"), {"pretty": "true"}).alias("value"))
    g.repartition("option").write.partitionBy("option").text(p)
    return S.read_results(spark, f"{p}/*", "option", "option string, kind string, vs_base struct<oof_dmse: double>").select("option", "vs_base.oof_dmse")


@query("src08", rounded_sql("members", "run", """
WITH f AS (SELECT g, fold, corr(p1, y) AS c FROM members WHERE fold IN (0, 1, 2) GROUP BY g, fold) SELECT g AS run, avg(c) AS p FROM f GROUP BY g""".replace(") SELECT g AS", ")\nSELECT g AS")))
def src08(spark, sf):
    p = scratch_path(spark, "scores")
    per = members(spark, sf).groupBy("g", "fold").agg(M.safe_corr("p1", "y").alias("c"))
    runs = per.groupBy(F.col("g").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("fold").cast("string"), F.struct(F.col("c").alias("p"))))).alias("per_fold"))
    runs.write.json(p)
    back = spark.read.schema("run string, per_fold map<string, struct<p: double>>").json(p)
    return rounded(S.run_scores(back, [0, 1, 2], "p"))


@query("snk01", rounded_sql("members", "experiment, n_folds", """
SELECT 'line' AS experiment, sqrt(avg((p1 - y) ** 2)) AS cv_rmse, CAST(5 AS INTEGER) AS n_folds FROM members"""))
def snk01(spark, sf):
    d = K.save_experiment(members(spark, sf), scratch_path(spark, "store"), "line", "p1")
    return rounded(d.select("experiment", "cv_rmse", F.size("fold_rmse").alias("n_folds")))


@query("snk02", rounded_sql("files", "id", "SELECT id, f2 AS pred FROM files"))
def snk02(spark, sf):
    f = files(spark, sf).select("id", F.col("f2").alias("pred"))
    p = K.save_candidate(f, scratch_path(spark, "cand"), "f2", f.count(), "SAFE", -1e6, 1e6)
    return rounded(spark.read.parquet(p).select("id", "pred"))


@query("snk03", rounded_sql("files", "id", "SELECT id, f3 AS pred FROM files"))
def snk03(spark, sf):
    return rounded(K.write_once(files(spark, sf).select("id", F.col("f3").alias("pred")), scratch_path(spark, "once")))


@query("snk04", rounded_sql("members", "id, fold", "SELECT id, fold, p1 FROM members"))
def snk04(spark, sf):
    m, p = members(spark, sf).select("id", "fold", "p1"), scratch_path(spark, "folds")
    K.checkpoint_folds(m.where("fold < 2"), p, "v1")
    return rounded(K.checkpoint_folds(m, p, "v1").select("id", "fold", "p1"))


@query("snk05", with_ctes("samples", "SELECT id, y FROM samples"))
def snk05(spark, sf):
    s, p = samples(spark, sf).select("id", "y"), scratch_path(spark, "shards")
    s.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")).write.partitionBy("shard").parquet(p)
    return K.merge_shards(spark, p, s).select("id", "y")


@query("snk06", "SELECT event_id AS id, value FROM events")
def snk06(spark, sf):
    e, p = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value"), scratch_path(spark, "chunk")
    K.dump_chunk(e, p, "events", ["value"])
    return K.ingest_chunk(spark, p, ["value"])


@query("snk07", rounded_sql("members", "id", "SELECT id, p2 AS pred FROM members"))
def snk07(spark, sf):
    m = members(spark, sf)
    claimed = m.agg(M.rmse("p2", "y").alias("r")).first()["r"]
    return rounded(K.ingest_result(m.select("id", F.col("p2").alias("pred")), m.select("id", "y"), claimed, scratch_path(spark, "ext")))


@query("snk08", rounded_sql("rows_", "feature", """
WITH lg AS (UNPIVOT (SELECT y, x1, x2, q1 FROM rows_) ON x1, x2, q1 INTO NAME feature VALUE value),
rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM lg)
SELECT feature, corr(rx, ry) AS rho FROM rk GROUP BY feature"""))
def snk08(spark, sf):
    s = spearman(rows(spark, sf), ["x1", "x2", "q1"], "y").select("feature", "rho")
    return rounded(K.write_report(s, scratch_path(spark, "report"), "rho", "feature"))


@query("udf01", rounded_sql("pixels", "id, n", "SELECT img AS id, count(*) AS n, avg(v) AS mean, max(v) AS top FROM pixels GROUP BY img"))
def udf01(spark, sf):
    """A per-entity function with one row out, as a combining aggregate."""
    return rounded(pixels(spark, sf).groupBy(F.col("img").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("top")))


@query("udf02", rounded_sql("pixels", "id, blk", "SELECT img AS id, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS blk, avg(v) AS meas FROM pixels GROUP BY 1, 2"))
def udf02(spark, sf):
    """A per-entity function with many rows out: one per block of the image."""
    blk = (F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("int")
    return rounded(pixels(spark, sf).groupBy(F.col("img").alias("id"), blk.alias("blk")).agg(F.avg("v").alias("meas")))
