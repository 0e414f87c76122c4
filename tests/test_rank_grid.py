"""Rank correlations of a grid: against pandas with NULLs, ties and subsets, and without copies of rows in a shuffle."""

import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratafold.operators import ranking as K


def _table(spark, n=400):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"y": rng.integers(0, 60, n) / 4, "r": rng.normal(size=n), "a": rng.integers(0, 5, n) * 1.0, "b": rng.normal(size=n), "c": rng.integers(0, 30, n) * 1.0,
                      "k": rng.integers(0, 3, n), "flat": np.ones(n)})
    p["a"] += np.where(p.y > 8, 2, 0)
    p.loc[p.index % 7 == 0, "c"] = np.nan
    p.loc[p.index % 11 == 0, "y"] = np.nan
    p.loc[p.index % 13 == 0, "b"] = np.nan
    rows = [tuple(None if v != v else v for v in r) for r in p.itertuples(index=False)]
    return p, spark.createDataFrame(rows, "y double, r double, a double, b double, c double, k long, flat double")


def test_grid_equals_pandas(spark):
    p, df = _table(spark)
    cols, targets = ["a", "b", "c", "flat"], ["y", "r"]
    got = K.spearman_grid(df, cols, targets, {"all": F.lit(True), "some": F.col("k") == 1, "none": F.col("k") > 5}).collect()
    assert {(g.subset, g.target, g.feature) for g in got} == {(s, t, c) for s in ("all", "some") for t in targets for c in cols}
    for g in got:
        q = (p if g.subset == "all" else p[p.k == 1])[[g.target, g.feature]].dropna()
        assert g.n == len(q)
        if g.feature == "flat":
            assert g.rho is None
        else:
            assert abs(g.rho - np.corrcoef(q[g.target].rank(), q[g.feature].rank())[0, 1]) < 1e-12


def test_rows_meet_ranks_once(spark):
    """One join of rows with ranks for all columns (two before, each over a copy of every row per column), and no join on a column's value."""
    df = spark.range(3000).select(F.col("id").cast("double").alias("y"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    out = io.StringIO()
    with redirect_stdout(out):
        K.spearman(df, ["a", "b"], "y").explain()
    assert "Generate inline" not in out.getvalue()  # the copies a column are added up before the last ranking reads them


def test_partitions_follow_the_rows(spark, monkeypatch):
    asked = []
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *c: (asked.append(n), plain(self, n, *c))[1])
    monkeypatch.setattr(K, "ROWS", 50)
    _, df = _table(spark)
    K.spearman(df, ["a", "b"], "y")
    assert max(asked) >= 8
    assert asked == [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 400 // 50)]
