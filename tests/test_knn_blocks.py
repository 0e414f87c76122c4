"""Neighbours by blocks of products against full comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratafold.operators import joins as J


@pytest.mark.parametrize("held,parts", [(7, 3), (40, 1), (1 << 17, None)])
def test_blocks_find_ties_copies_and_asked_rows(spark, held, parts):
    r = np.random.default_rng(held)
    x = np.concatenate([r.integers(0, 4, (150, 3)), np.full((60, 3), 2), r.normal(size=(40, 3)) * 50]).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>").repartition(5)
    got = J.knn_blocks(df, 6, F.col("id") % 4 == 0, held, parts).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[::4, :6]
    assert (got.id.to_numpy().reshape(-1, 6)[:, 0] == np.arange(0, 250, 4)).all()
    assert (got.nb.to_numpy().reshape(-1, 6) == want).all() and np.allclose(got["dist"].to_numpy().reshape(-1, 6), np.take_along_axis(d[::4], want, 1))


def test_wide_vectors_carry_no_vector_to_every_cell(spark, monkeypatch):
    """Before, every row of a wide table visited all cells with its own vector."""
    monkeypatch.setattr(J.PivotTree, "visits", None)
    x = np.random.default_rng(1).normal(size=(120, 24))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, vec array<double>")
    got = J.knn(df, 5, leaf=10).toPandas().sort_values(["id", "rank"]).nb.to_numpy().reshape(-1, 5)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert (got == np.argsort(d, axis=1)[:, :5]).all()
    assert J.knn_blocks(df.limit(0), 5).isEmpty()
    assert [(p.id, p.nb) for p in J.knn_blocks(df.where("id < 2"), 5).orderBy("id").collect()] == [(0, 1), (1, 0)]


@pytest.mark.parametrize("name", ["jon07", "rsm10"])
def test_every_row_asks(spark, name):
    """Before, only identifiers that 20 divides were asked."""
    sf = "/root/testdata/sf0.001"
    got, rows = entry.queries()[name](spark, sf), spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert (got.count() == 5 * rows) if name == "jon07" else (got.first().n == rows)
