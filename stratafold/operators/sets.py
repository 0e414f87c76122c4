"""Set operations on keyed tables and prediction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import KeyViolation


def union_tagged(parts: dict[str, DataFrame], tag: str = "src") -> DataFrame:
    out = None
    for name, p in parts.items():
        t = p.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def disjoint_changes(base: DataFrame, changes: Sequence[DataFrame], key: str = "id", value: str = "pred") -> DataFrame:
    """Union of row changes over a base; a key changed by two files is an error.

    All files meet in one grouping, and one pass over it both checks the overlap and picks the value.
    """
    b = base.select(key, F.col(value).alias("_v"), F.lit(-1).alias("_f"))
    for i, c in enumerate(changes):
        b = b.unionByName(c.select(key, F.col(value).alias("_v"), F.lit(i).alias("_f")))
    base_v = F.max(F.when(F.col("_f") == -1, F.col("_v")))
    g = b.groupBy(key).agg(base_v.alias("_base"), *[F.max(F.when(F.col("_f") == i, F.col("_v"))).alias(f"_c{i}") for i in range(len(changes))])
    moved = [F.when(F.col(f"_c{i}") != F.col("_base"), F.col(f"_c{i}")) for i in range(len(changes))]
    n = sum((m.isNotNull().cast("int") for m in moved), F.lit(0))
    if g.where(n > 1).limit(1).count():
        raise KeyViolation("row changed by more than one file")
    return g.select(key, F.coalesce(*moved, F.col("_base")).alias(value), n.cast("int").alias("n_changes"))


def additive_changes(df: DataFrame, base: str, files: Sequence[str]) -> DataFrame:
    """Base plus the sum of every file's difference from the base."""
    total = sum((F.col(f) - F.col(base) for f in files), F.lit(0.0))
    return df.select("id", (F.col(base) + total).alias("pred"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side's name; empty when the key sets agree."""
    left = a.select(key).exceptAll(b.select(key)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).exceptAll(a.select(key)).withColumn("side", F.lit("right")))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest order; a combining aggregate, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")
    return df.groupBy(*keys).agg(last).select(*keys, "_s.*")


def drop_duplicate_columns(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    seen: set[str] = {key}
    out = None
    for t in tables:
        cols = [c for c in t.columns if c not in seen]
        seen.update(cols)
        part = t.select(key, *cols)
        out = part if out is None else out.join(part, key)
    return out
