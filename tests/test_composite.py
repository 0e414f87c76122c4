"""Composite fidelity against whole-array figures on columns far from zero."""

import numpy as np
import pytest

from stratafold.operators import compare as C


def test_figures_keep_their_digits_far_from_zero_and_ties_go_by_name(spark):
    r = np.random.default_rng(1)
    n = 400
    x, z = r.normal(size=(2, n))
    cols = {"x": 1e7 + x, "z": 3e7 + z, "a": 1e7 + x + 0.3 * r.normal(size=n), "b": 3e7 + 2 + z + 0.3 * r.normal(size=n), "c": 1e7 + x + 0.1 * r.normal(size=n), "d": 3e7 + z + 0.2 * r.normal(size=n)}
    y = x + 2 * z + r.normal(size=n)
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(np.column_stack(list(cols.values())), y)], [*cols, "y"])
    variants = {"one": {"x": "a", "z": "b"}, "two": {"x": "c", "z": "d"}}
    got = {p.variant: p for p in C.composite_fidelity(df, "y", ["x", "z"], variants).collect()}
    m = np.column_stack([np.ones(n), cols["x"] - 1e7, cols["z"] - 3e7])
    w = np.linalg.lstsq(m, y, rcond=None)[0]
    f0 = m @ w
    for name, (p, q) in {"one": ("a", "b"), "two": ("c", "d"), "composite": ("c", "d")}.items():
        f = w[0] + w[1] * (cols[p] - 1e7) + w[2] * (cols[q] - 3e7)
        g = got[name]
        assert g["corr"] == pytest.approx(np.corrcoef(f, f0)[0, 1], abs=1e-6) and g.rmse == pytest.approx(np.sqrt(((f - f0) ** 2).mean()), abs=1e-5)
        assert g.bias == pytest.approx((f - f0).mean(), abs=1e-5) and g.term_corr[0] == pytest.approx(np.corrcoef(cols[p], cols["x"])[0, 1], abs=1e-6)
    assert got["composite"].chosen and not got["two"].chosen  # the same columns: the first name
