"""Pivot tree and lower envelope against full comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.operators import joins as J


def neighbours(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("leaf,chunk", [(10, 7), (60, 4096), (10_000, 50)])
def test_knn_with_ties_and_copies(spark, leaf, chunk):
    r = np.random.default_rng(leaf)
    x = np.concatenate([r.integers(0, 6, (150, 2)), np.full((60, 2), 3), r.normal(size=(40, 2)) * 50]).astype(float)
    got = J.knn(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>").repartition(5), 6, leaf, chunk)
    got = got.toPandas().sort_values(["id", "rank"])
    ids, dist = neighbours(x, 6)
    assert len(got) == len(x) * 6
    assert np.allclose(got.dist.to_numpy().reshape(-1, 6), dist) and (got.nb.to_numpy().reshape(-1, 6) == ids).all()


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, vec array<double>")
    assert [(r.id, r.nb) for r in J.knn(df, 5).orderBy("id", "rank").collect()] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1)]
    assert J.knn(df.limit(0), 5).count() == 0


def test_most_pairs_are_ruled_out_in_few_dimensions(spark):
    """Three columns of the order table of the larger fixture."""
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    o = li.groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("c")).where("l_orderkey % 8 = 0")
    df = o.select(F.col("l_orderkey").alias("id"), F.array(F.col("a") * 30, F.col("b") * 40, F.col("c") / 14).alias("vec"))
    n, visited = df.count(), []
    got = J.knn(df, 5, visited=visited)
    assert n > 4_000 and visited[0] < n * n / 2
    assert got.count() == 5 * n
    print(n, visited[0] / n / n)


def test_envelope_equals_the_least_of_all(spark):
    r = np.random.default_rng(8)
    for _ in range(300):
        n = int(r.integers(1, 12))
        y = np.sort(r.choice(20, n, replace=False)).tolist()
        h = r.integers(0, 60, n).tolist()
        keep, start = J.lower_envelope(y, h)
        for q in range(-2, 24):
            at = max(i for i, s in enumerate(start) if s <= q)
            assert keep[at] == min(range(n), key=lambda i: ((q - y[i]) ** 2 + h[i], i))


def test_fill_nearest_equals_a_search(spark):
    r = np.random.default_rng(9)
    rows, want = [], {}
    for img in range(3):
        v = r.integers(0, 50, (9, 14))
        hole = r.random((9, 14)) < (0.6, 0.95, 1.0)[img]
        rows += [(img, y, x, int(v[y, x]), bool(hole[y, x])) for y in range(9) for x in range(14)]
        open_ = [(y, x) for y in range(9) for x in range(14) if not hole[y, x]]
        for y in range(9):
            for x in range(14):
                best = min(open_, key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, *p), default=None)
                want[img, y, x] = int(v[y, x]) if not hole[y, x] else None if best is None else int(v[best])
    df = spark.createDataFrame(rows, "img long, y int, x int, v int, hole boolean").repartition(4)
    got = {(p.img, p.y, p.x): p.v for p in J.fill_nearest(df, F.col("hole"), "v").collect()}
    assert got == want
