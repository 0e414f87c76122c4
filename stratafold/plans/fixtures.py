"""Shared views over the driver's tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import row_numbers
from ..operators.columns import stratum
from ..operators.folds import stratified_folds
from ..session import path_exists, scratch_path

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, body.strip())


def with_ctes(names: str, body: str) -> str:
    """``WITH`` clause holding the named views and everything they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for n in names.split():
        visit(n)
    ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Table written once per application to the shared folder, then scanned with column pruning.

    Fold and feature tables are artifacts here: assigned once, read by every later fit, so the
    assignment is not recomputed in each stage and does not change when an executor is lost.
    """
    where = (spark.sparkContext.applicationId, sf, name)
    path = _STORED.get(where)
    if path is None or not path_exists(spark, path + "/_SUCCESS"):
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[where] = path
    return spark.read.parquet(path)


# ---------------------------------------------------------------- entity table
_cte("samples", """
SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) / 1000 AS y, sum(l_quantity) AS x1,
       round(avg(l_discount), 6) AS x2, round(avg(l_tax), 6) AS x3, CAST(count(*) AS DOUBLE) AS x4,
       max(l_quantity) AS x5, round(avg(l_quantity), 6) AS q1, CAST(1 + count(*) AS DOUBLE) AS q2
FROM lineitem GROUP BY l_orderkey""")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.round(F.sum("l_extendedprice"), 2) / 1000).alias("y"),
        F.sum("l_quantity").alias("x1"),
        F.round(F.avg("l_discount"), 6).alias("x2"),
        F.round(F.avg("l_tax"), 6).alias("x3"),
        F.count(F.lit(1)).cast("double").alias("x4"),
        F.max("l_quantity").alias("x5"),
        F.round(F.avg("l_quantity"), 6).alias("q1"),
        (F.count(F.lit(1)) + 1).cast("double").alias("q2"),
    )


_cte("deciles", """
SELECT list_distinct(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM samples""", "samples")
_cte("binned", """
SELECT s.*, CAST(len(list_filter(edges, lambda e: e < s.y)) AS INTEGER) AS bin FROM samples s, deciles""", "deciles")
_cte("folds", """
SELECT *, CAST((row_number() OVER (PARTITION BY bin ORDER BY id) - 1) % 5 AS INTEGER) AS fold FROM binned""", "binned")


def folds(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles, bucket edges and numbering each read the entity table, so it is aggregated and written once."""
    return stratified_folds(stored(spark, sf, "samples", lambda: samples(spark, sf)), "id", "y")


# columns with missing values, strata and train/test flag
_cte("rows_", """
SELECT *, CASE WHEN x2 > 0.06 THEN NULL ELSE x1 END AS x1n, CASE WHEN x3 > 0.05 THEN NULL ELSE x5 END AS x5n,
  CASE WHEN q1 < 20 THEN 'clean' WHEN q1 < 26 AND x2 >= 0.05 THEN 'LV' WHEN q1 < 26 THEN 'midLF'
       WHEN x2 >= 0.05 THEN 'HLV' ELSE 'G1hi' END AS g
FROM folds""", "folds")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "rows", lambda: folds(spark, sf).withColumns({
        "x1n": F.when(F.col("x2") > 0.06, None).otherwise(F.col("x1")),
        "x5n": F.when(F.col("x3") > 0.05, None).otherwise(F.col("x5")),
        "g": stratum("q1", "x2", 20.0, 26.0, 0.05),
    }))


def train_rows():
    """The last fold plays the unlabelled part."""
    return F.col("fold") != 4



# ---------------------------------------------------------------- members
_cte("memfit", """
SELECT k.fold AS fold, regr_slope(f.y, f.x1) AS b1, regr_intercept(f.y, f.x1) AS a1,
       regr_slope(f.y, f.x4) AS b4, regr_intercept(f.y, f.x4) AS a4
FROM (SELECT DISTINCT fold FROM folds) k JOIN folds f ON f.fold <> k.fold GROUP BY k.fold""", "folds")
_cte("members", """
SELECT r.*, a1 + b1 * x1 AS p1, a4 + b4 * x4 AS p2 FROM rows_ r JOIN memfit USING (fold)""", "rows_", "memfit")


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with two out-of-fold member predictions p1 (from x1) and p2 (from x4)."""
    from ..operators.gram import crossfit_ols

    r = rows(spark, sf)
    r = crossfit_ols(r, "y", ["x1"], out="p1")
    return crossfit_ols(r, "y", ["x4"], out="p2")


# ---------------------------------------------------------------- regions
_cte("regions", """
SELECT l_partkey AS img, l_orderkey AS okey, l_linenumber AS line, l_quantity AS area,
       CAST(l_orderkey % 256 AS DOUBLE) AS cy, CAST((l_suppkey * 7 + l_orderkey) % 256 AS DOUBLE) AS cx,
       pi() * l_discount * 10 AS theta, 1 + l_tax * 10 AS asp,
       l_extendedprice / (l_quantity * 2000) AS grey, l_linestatus = 'F' AS border, l_extendedprice AS price
FROM lineitem""")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("img"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("area"), (F.col("l_orderkey") % 256).cast("double").alias("cy"),
        ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 256).cast("double").alias("cx"),
        (F.pi() * F.col("l_discount") * 10).alias("theta"), (1 + F.col("l_tax") * 10).alias("asp"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * 2000)).alias("grey"),
        (F.col("l_linestatus") == "F").alias("border"), F.col("l_extendedprice").alias("price"))


# ---------------------------------------------------------------- rasters
_cte("pixels", """
SELECT vec_id AS img, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
       CAST(embedding[i] AS DOUBLE) AS v
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")


IMAGES = 1 << 13  # images of one partition


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Long raster. The compact image rows are shuffled by image *before* they are exploded, so every
    later window or grouping on the image (or on a line of it) runs without another exchange. Their number of partitions follows
    the images, because partitions that are joined by compact bytes hold ever more pixels."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), "embedding")
    n = max(spark.sparkContext.defaultParallelism, -(-e.count() // IMAGES))
    e = e.repartition(n, "img")
    return e.select("img", F.posexplode("embedding").alias("pos", "v")).select(
        "img", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"))


_cte("labelmap", "SELECT img, y, x, v, CAST(floor((v + 1) * 4) AS INTEGER) AS lab FROM pixels", "pixels")


def labelmap(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumn("lab", F.floor((F.col("v") + 1) * 4).cast("int"))


_cte("mask", "SELECT img, y, x, v, v < 0 AS m FROM pixels", "pixels")


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumn("m", F.col("v") < 0)


_cte("blocks", """
SELECT img AS id, CAST(y // 2 AS INTEGER) AS by, CAST(x // 2 AS INTEGER) AS bx,
       CAST((y // 2) * 4 + x // 2 AS INTEGER) AS blk, avg(v) AS meas, max(v) AS ctx
FROM pixels GROUP BY ALL""", "pixels")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    by, bx = F.floor(F.col("y") / 2).cast("int"), F.floor(F.col("x") / 2).cast("int")
    return pixels(spark, sf).groupBy(F.col("img").alias("id"), by.alias("by"), bx.alias("bx")).agg(
        F.avg("v").alias("meas"), F.max("v").alias("ctx")).withColumn("blk", F.col("by") * 4 + F.col("bx"))


_cte("variants", """
SELECT img AS id, var, avg(v) AS meas FROM pixels, (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS var)
WHERE (y + x + var) % 5 <> 0 GROUP BY img, var""", "pixels")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Five measurements of every image, each leaving out one diagonal family of pixels."""
    p = pixels(spark, sf).withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return p.where((F.col("y") + F.col("x") + F.col("var")) % 5 != 0).groupBy(
        F.col("img").alias("id"), "var").agg(F.avg("v").alias("meas"))


_cte("vectors", """
SELECT vec_id AS id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS v, label
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("dim", "_v")).select(
        "id", "dim", F.col("_v").cast("double").alias("v"), "label")


_cte("seq", "SELECT event_id AS id, value, event_type, user_id FROM events")


def seq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "value", "event_type", "user_id")


# ---------------------------------------------------------------- prediction files
_cte("files", """
SELECT id, y, fold, g, x2, y - 0.10 * (x1 - 100) AS f0, y - 0.08 * (x1 - 100) + 0.5 * x4 AS f1,
       y - 0.05 * (x1 - 100) + 0.5 * x4 AS f2, y - 0.05 * (x1 - 100) + CASE WHEN g = 'clean' THEN 0.2 * x5 ELSE 0.5 * x4 END AS f3
FROM rows_""", "rows_")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Four fixed prediction columns f0..f3; f1..f3 are each derived from the one before."""
    r = rows(spark, sf)
    d = F.col("x1") - 100
    half = F.lit(0.5) * F.col("x4")
    return r.select("id", "y", "fold", "g", "x2", (F.col("y") - 0.10 * d).alias("f0"),
                    (F.col("y") - 0.08 * d + half).alias("f1"), (F.col("y") - 0.05 * d + half).alias("f2"),
                    (F.col("y") - 0.05 * d + F.when(F.col("g") == "clean", 0.2 * F.col("x5")).otherwise(half)).alias("f3"))


# region rows numbered inside their image
_cte("labelled", """
SELECT *, row_number() OVER (PARTITION BY img ORDER BY okey, line, area, cx, price, theta, asp, grey, border) AS label
FROM regions""", "regions")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    order = ["okey", "line", "area", "cx", "price", "theta", "asp", "grey", "border"]
    return row_numbers(regions(spark, sf), ["img"], order, "label")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(names: str, keep: str, body: str, digits: int = 6) -> str:
    """Oracle text with every column but ``keep`` rounded."""
    sep = f"{keep}, " if keep else ""
    ex = f" EXCLUDE ({keep})" if keep else ""
    body = body.strip()
    pre = ""
    if body[:5].upper() == "WITH ":
        cut = body.rindex("\nSELECT")
        pre, body = body[:cut] + "\n", body[cut:]
    return with_ctes(names, f"{pre}SELECT {sep}round(COLUMNS(*{ex}), {digits}) FROM ({body})") if names else f"{pre}SELECT {sep}round(COLUMNS(*{ex}), {digits}) FROM ({body})"
