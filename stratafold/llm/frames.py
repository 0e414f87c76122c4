"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, whatever other columns (``TEXT`` beside ``text``) are there."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors. Its shuffle files go as
    soon as it is written, so the disk holds those of one step only."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for file in t.inputFiles():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def by_hash(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    return df.repartition(n, *keys)
