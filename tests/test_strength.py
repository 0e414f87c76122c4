"""Queries run resampling with as many replicates as the reference."""

import inspect

from stratafold.operators import mixtures, resample
from stratafold.plans import comparisons, fits


class Called(Exception):
    pass


def replicates(monkeypatch, spark, module, name, query, argument):
    """The value of an argument that the query calls an operator with."""
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        raise Called(bound.arguments[argument])

    monkeypatch.setattr(module, name, stop)
    try:
        query(spark, "/root/testdata/sf0.001")
    except Called as c:
        return c.args[0]


def test_replicates(monkeypatch, spark):
    assert replicates(monkeypatch, spark, resample, "refit_permutation", comparisons.rsm02, "n") == 2000
    assert replicates(monkeypatch, spark, mixtures, "mixture_share", fits.fit37, "reps") == 500
