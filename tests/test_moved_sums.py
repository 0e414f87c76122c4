"""Permutation sums that are added up inside the tasks, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions.permute import Shuffle, permutation
from stratafold.operators import resample as R


@pytest.mark.parametrize("n", [1, 2, 3, 7, 101, 5000])
def test_tabulated_rounds_equal_the_permutation(n):
    x = np.arange(n)
    for rep in range(20):
        got = np.concatenate([p for _, p in Shuffle(x, n, 3).places(rep, 64)])
        assert (got == permutation(x, np.int64(n), rep, 3)).all()


@pytest.mark.parametrize("held", [1 << 26, 1])
def test_moved_grams_equal_loops_over_groups_blocks_and_gaps(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "CHUNK", 16)
    r = np.random.default_rng(3)
    n = 150
    x, z, y = r.normal(size=(3, n))
    g, fold = [None if i % 5 == 4 else i % 3 for i in range(n)], np.arange(n) % 4
    for gap in (False, True):
        zz = np.where((np.arange(n) % 11 == 0) & gap, np.nan, z)
        df = spark.createDataFrame([(i, g[i], int(fold[i]), float(x[i]), None if np.isnan(zz[i]) else float(zz[i]), None if i == 7 else float(y[i])) for i in range(n)],
                                   "id long, g int, fold int, x double, z double, y double").repartition(4)
        _, got = R.moved_grams(df, "y", ["x", "z"], ["z"], "id", ["g"], 5)
        for rep in range(5):
            moved = zz.copy()
            for k in {None, 0, 1, 2}:
                own = np.array([i for i in range(n) if g[i] == k])
                moved[own] = zz[own[permutation(np.arange(len(own)), np.int64(len(own)), rep)]]
            for f in range(4):
                m = np.column_stack([np.ones(n), x, moved, np.where(np.arange(n) == 7, np.nan, y)])[fold == f]
                m = m[~np.isnan(m).any(1)]
                assert np.allclose(got[rep][(f,)], m.T @ m)


@pytest.mark.parametrize("held", [1 << 26, 1])
def test_largest_correlation_with_missing_values(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "CHUNK", 16)
    r = np.random.default_rng(4)
    n = 90
    rows = [(i, *[None if (i + 2 * c) % 9 == 0 and c != 1 else float(r.integers(0, 30)) for c in range(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    import pandas as pd

    rank = pd.DataFrame(rows, columns=["id", "a", "b", "y"])[["a", "b", "y"]].rank()

    def most(ry):
        return max(abs(rank[c].corr(pd.Series(ry))) for c in ("a", "b"))

    null = np.array([most(rank.y.to_numpy()[permutation(np.arange(n), np.int64(n), rep)]) for rep in range(30)])
    got = R.max_correlation_null(df, ["a", "b"], "y", "id", 30).first()
    assert got.observed == pytest.approx(most(rank.y)) and got.null_median == pytest.approx(np.median(null))
    assert got.null_95 == pytest.approx(np.quantile(null, 0.95)) and got.p == pytest.approx((1 + (null >= got.observed).sum()) / 31)
