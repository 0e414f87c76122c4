"""Scans: keyed CSV, projected Parquet, image folders, nested JSON results, embedding blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import KeyViolation


def read_labels(spark: SparkSession, labels: str, folds: str, key: str = "id") -> DataFrame:
    """Label and fold files with fixed schemas, joined on the key."""
    a = spark.read.csv(labels, header=True, schema=f"{key} bigint, y double")
    b = spark.read.csv(folds, header=True, schema=f"{key} bigint, fold int")
    return a.join(b, key)


def read_keys(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col(key).cast("bigint").alias(key))


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def read_images(spark: SparkSession, path: str, invalid: str = "raise") -> DataFrame:
    """Grey pixels (img, y, x, v in 0..1) of an image folder; colour channels are averaged.

    Unreadable files raise ``KeyViolation``, or with ``invalid="keep"`` give one row (img, NULL, NULL, NULL).
    """
    i = spark.read.format("image").load(path).select("image.*")
    bad = (F.col("width") <= 0) | F.col("data").isNull()
    if invalid == "raise":
        lost = i.where(bad).select("origin").limit(1).collect()
        if lost:
            raise KeyViolation(f"unreadable image {lost[0]['origin']}")

    def grey(batches):
        for b in batches:
            for name, w, h, n, data in zip(b["img"], b["width"], b["height"], b["nChannels"], b["data"]):
                if w <= 0:
                    yield pd.DataFrame({"img": [name], "y": pd.array([None], "Int32"), "x": pd.array([None], "Int32"), "v": [None]})
                    continue
                v = np.frombuffer(data, np.uint8).reshape(h, w, n).mean(axis=2).ravel() / 255
                at = np.arange(h * w, dtype=np.int32)
                yield pd.DataFrame({"img": name, "y": at // w, "x": at % w, "v": v})

    name = F.regexp_extract("origin", r"([^/]+)\.[^.]+$", 1)
    return i.select(name.alias("img"), "width", "height", "nChannels", "data").mapInPandas(grey, "img string, y int, x int, v double")


def embedding_blocks(df: DataFrame, key: str, emb: str, layout: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Named slices of an embedding column (name, start, end) as rows (key, block, emb)."""
    parts = [F.struct(F.lit(n).alias("block"), F.slice(emb, a + 1, b - a).alias("emb")) for n, a, b in layout]
    return df.select(key, F.inline(F.array(*parts)))


def read_results(spark: SparkSession, path: str, kind: str | None = "option", schema: str | None = None) -> DataFrame:
    """Nested result files, one JSON object per file, wherever its line breaks are; ``kind`` keeps the files of one kind. A given
    schema saves the scan that would infer it."""
    r = spark.read.option("multiLine", True)
    d = (r if schema is None else r.schema(schema)).json(path)
    return d if kind is None else d.where(F.col("kind") == kind)


def run_scores(runs: DataFrame, folds: Sequence[int], metric: str) -> DataFrame:
    """Mean metric of each run over the chosen folds; a missing fold is an error.

    ``runs`` has (run, per_fold map<string, struct>).
    """
    long = runs.select("run", F.explode("per_fold").alias("fold", "m")).where(F.col("fold").cast("int").isin(list(folds)))
    g = long.groupBy("run").agg(F.avg(F.col(f"m.{metric}")).alias(metric), F.countDistinct("fold").alias("k"))
    bad = g.where(F.col("k") != len(set(folds))).limit(1).collect()
    if bad:
        raise KeyViolation(f"run {bad[0]['run']}: folds missing")
    return g.drop("k")
