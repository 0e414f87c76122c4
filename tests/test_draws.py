"""Sums of draws that are added up inside the tasks, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions import mix as M
from stratafold.operators import resample as R


def counts(key, rep):
    return np.searchsorted([level for _, level in M._levels()], M.mix(key, rep) / 2**31, side="right")


def test_mixer_and_counts_equal_the_plain_numbers():
    key = np.array([0, 1, 5, 10**6, 2**33 + 5, -3, *range(100, 4000)])
    at = M.mixer(key, 4)
    assert all((at(r) == M.mix(key, r, 4)).all() for r in range(20))
    h = np.concatenate([[0, 2**31 - 1], *[[int(t) - 1, int(t)] for t in M._STEPS if t < 2**31]]).astype(np.uint32)
    assert (M.poisson_counts(h) == np.searchsorted([level for _, level in M._levels()], h / 2**31, side="right")).all()


def test_bootstrap_equals_a_loop_and_leaves_one_row_a_replicate_and_task(spark):
    r = np.random.default_rng(1)
    n = 300
    v = r.normal(size=n)
    df = spark.createDataFrame([(i // 2, None if i % 7 == 0 else float(v[i])) for i in range(n)], "k long, v double").repartition(3)
    sums = {"w": F.lit(1.0), "v": F.col("v")}
    got = R.bootstrap(df, "k", sums, F.col("v") / F.col("w"), 40).first()
    known = np.arange(n) % 7 != 0
    s = np.array([(w * np.where(known, v, 0)).sum() / w.sum() for w in (counts(np.arange(n) // 2, rep) for rep in range(40))])
    assert got.mean == pytest.approx(s.mean()) and got.sd == pytest.approx(s.std(ddof=1)) and got.lo == pytest.approx(np.quantile(s, 0.05)) and got.p_ge0 == pytest.approx((s >= 0).mean())
    d = M.drawn_sums(df, "k", {"v": F.col("v"), "none": F.lit(None)}, range(40))
    assert d.count() == 40 and d.where("none is not null or v is null").isEmpty() and M.drawn_sums(df.limit(0), "k", sums, range(4)).isEmpty()


def test_sign_flip_equals_a_loop(spark):
    r = np.random.default_rng(2)
    d, n = r.normal(size=90) - 0.1, 200
    got = R.sign_flip(spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)] + [(90, None)], "id long, d double"), "d", "id", n).first()
    m = [(d * (1 - 2 * ((M.mix(np.arange(90), f // 31) >> (f % 31)) & 1))).mean() for f in range(n)]
    assert got.observed == pytest.approx(d.mean()) and got.p == pytest.approx((1 + np.sum(np.array(m) <= d.mean() + 1e-12)) / (n + 1))
