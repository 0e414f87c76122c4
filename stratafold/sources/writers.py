"""Sinks with contracts: experiment store, candidates, verified and resumable writes, text chunks."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import KeyViolation, require_unique
from ..operators.metrics import rmse
from ..session import path_exists


def require(cond: bool, what: str) -> None:
    if not cond:
        raise KeyViolation(what)


def save_experiment(df: DataFrame, root: str, name: str, pred: str = "pred", y: str = "y", fold: str = "fold", notes: str = "") -> DataFrame:
    """Out-of-fold rows to a partition of the store and one line to the leaderboard; returns that line."""
    df.select("id", fold, F.col(pred).alias("pred")).write.mode("errorifexists").parquet(f"{root}/oof/experiment={name}")
    per = df.groupBy(fold).agg(rmse(pred, y).alias("r")).agg(F.array_sort(F.collect_list(F.struct(fold, "r"))).alias("f"), F.lit(1).alias("_k"))
    row = df.agg(rmse(pred, y).alias("cv_rmse"), F.lit(1).alias("_k")).join(per, "_k").select(
        F.lit(name).alias("experiment"), "cv_rmse", F.transform("f", lambda s: s["r"]).alias("fold_rmse"), F.lit(notes).alias("notes"))
    row.write.mode("append").parquet(f"{root}/leaderboard")
    return df.sparkSession.read.parquet(f"{root}/leaderboard").where(F.col("experiment") == name)


def save_candidate(df: DataFrame, root: str, name: str, rows: int, verdict: str, lo: float = 0.0, hi: float = 1000.0, value: str = "pred") -> str:
    """Contract check (row count, finite, bounds), then a write whose place depends on the verdict."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > lo) & (F.col(value) < hi)
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum((~ok).cast("bigint")).alias("bad")).first()
    require(c["n"] == rows, f"{name}: {c['n']} rows, expected {rows}")
    require(not c["bad"], f"{name}: {c['bad']} values missing or out of bounds")
    path = f"{root}/{'rejected' if verdict == 'FAIL' else 'candidate'}={name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Never overwrites; reads the file back and compares it with the rows both ways."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path).select(*df.columns)
    require(back.exceptAll(df).limit(1).count() == 0 and df.exceptAll(back).limit(1).count() == 0, f"{path}: read-back differs")
    return back


def checkpoint_folds(df: DataFrame, root: str, config: str, fold: str = "fold") -> DataFrame:
    """Writes only folds that are not stored yet; refuses to pool folds made with another configuration."""
    spark = df.sparkSession
    tagged = df.withColumn("config", F.xxhash64(F.lit(config)))
    if path_exists(spark, root):
        old = spark.read.parquet(root)
        tags = [r["config"] for r in old.select("config").distinct().limit(2).collect()]
        mine = spark.range(1).select(F.xxhash64(F.lit(config)).alias("c")).first()["c"]
        require(tags == [mine], f"{root}: folds of a different configuration")
        tagged = tagged.join(old.select(fold).distinct(), fold, "left_anti")
    tagged.write.mode("append").partitionBy(fold).parquet(root)
    return spark.read.parquet(root)


def merge_shards(spark: SparkSession, root: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """Union of the shard folders, which must hold exactly the expected keys."""
    d = spark.read.parquet(root)
    got = d.select(key)
    require(got.exceptAll(keys.select(key)).limit(1).count() == 0, "shards hold unexpected or repeated keys")
    require(keys.select(key).exceptAll(got).limit(1).count() == 0, "shards miss keys")
    return d


def dump_chunk(df: DataFrame, path: str, name: str, cols: Sequence[str], key: str = "id") -> None:
    """Text chunk: header line, CSV rows with 4 decimals, and a line of column sums."""
    r = df.select(key, *[F.round(c, 4).alias(c) for c in cols])
    sums = r.agg(*[F.sum(F.col(c).cast("decimal(28,4)")).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
    head = sums.select(F.format_string(f"# {name} chunk (%d rows)", F.col("_n")).alias("value"))
    tail = sums.select(F.concat(F.lit("# sums "), F.concat_ws(" ", *[F.concat(F.lit(c + " "), F.col(c).cast("decimal(38,4)").cast("string")) for c in cols])).alias("value"))
    body = r.select(F.concat_ws(",", F.col(key).cast("string"), *[F.col(c).cast("decimal(38,4)").cast("string") for c in cols]).alias("value"))
    head.unionByName(tail).unionByName(body).write.mode("errorifexists").text(path)


def ingest_chunk(spark: SparkSession, path: str, cols: Sequence[str], key: str = "id") -> DataFrame:
    """Parses a text chunk and checks its header count, key uniqueness and column sums."""
    t = spark.read.text(path)
    is_sum = F.col("value").startswith("# sums")
    one = t.where(F.col("value").startswith("# ")).groupBy(is_sum.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).collect()
    meta = {r["s"]: r for r in one}  # at most two rows, whatever the number of lines
    require(len(meta) == 2 and all(r["n"] == 1 for r in one), f"{path}: header or sums line missing or repeated")
    head, sums = [meta[False]["value"]], [meta[True]["value"]]
    parts = F.split("value", ",")
    d = t.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        parts[0].cast("bigint").alias(key), *[parts[i + 1].cast("double").alias(c) for i, c in enumerate(cols)])
    require_unique(d, [key], path)
    tok = sums[0].split()[2:]
    ref = {tok[i]: Decimal(tok[i + 1]) for i in range(0, len(tok) - 1, 2)}
    got = d.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("decimal(28,4)")).alias(c) for c in cols]).first()
    require(f"({got['_n']} rows)" in head[0], f"{path}: row count differs")
    for c in cols:
        require(c in ref and got[c] == ref[c], f"{path}: sum of {c} differs")  # decimals: exact at any size
    return d


def ingest_result(pred: DataFrame, truth: DataFrame, claimed: float, path: str, key: str = "id", y: str = "y", value: str = "pred") -> DataFrame:
    """External result: schema, key set, uniqueness, finiteness and the recomputed score before it is written."""
    require(pred.columns == [key, value], f"columns {pred.columns}")
    require_unique(pred, [key], "result")
    a, b = pred.select(key), truth.select(key)
    require(a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0, "key sets differ")
    require(pred.where(F.col(value).isNull() | F.isnan(value)).limit(1).count() == 0, "non-finite values")
    got = pred.join(truth, key).agg(rmse(value, y).alias("r")).first()["r"]
    require(abs(got - claimed) < 1e-3, f"score {got} does not match {claimed}")
    pred.write.mode("errorifexists").parquet(path)
    return pred.sparkSession.read.parquet(path)


def write_report(rows: DataFrame, path: str, score: str, name: str) -> DataFrame:
    """A short report sorted by falling score, as CSV."""
    rows.orderBy(F.desc(score), name).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
    return rows.sparkSession.read.csv(path, header=True, schema=", ".join(f"{c} {t}" for c, t in rows.dtypes))
