"""Tiled labelling against a flood fill of whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.operators import components as C


def flood(v, eight):
    h, w = v.shape
    lab = np.full((h, w), -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for y in range(h):
        for x in range(w):
            if v[y, x] >= 0 and lab[y, x] < 0:
                stack, lab[y, x] = [(y, x)], y * w + x
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        p = a + dy, b + dx
                        if 0 <= p[0] < h and 0 <= p[1] < w and lab[p] < 0 and v[p] == v[y, x]:
                            lab[p] = y * w + x
                            stack.append(p)
    return lab


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("tile", [1, 3, 5, 64])
def test_tiles_give_the_labels_of_whole_images(spark, eight, tile):
    r = np.random.default_rng(tile)
    spiral = np.full((17, 17), -1)
    for k in range(0, 8, 2):
        spiral[k, k:17 - k], spiral[k:17 - k, 16 - k], spiral[16 - k, k:17 - k], spiral[k + 2:17 - k, k] = 1, 1, 1, 1
        spiral[k + 2, k:k + 2] = 1
    images = [r.integers(-1, 2, (13, 9)), r.integers(0, 2, (6, 21)), np.zeros((11, 11), int), spiral]
    rows = [(i, y, x, int(v[y, x])) for i, v in enumerate(images) for y in range(v.shape[0]) for x in range(v.shape[1])]
    df = spark.createDataFrame(rows, "img long, y int, x int, v int").repartition(4)
    got = [np.full(v.shape, -1) for v in images]
    for p in C.raster_components(df, F.when(F.col("v") >= 0, F.col("v")).otherwise(-1), eight, tile).collect():
        got[p.img][p.y, p.x] = -1 if p.comp is None else p.comp
    for v, g in zip(images, got):
        assert (g == flood(v, eight)).all()


def test_pixels_are_never_broadcast(spark):
    """Many equal images pack into a small file; its pixels must not be sent through the driver for that."""
    px = spark.range(300).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(
        F.col("id").alias("img"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), (F.col("p") % 3 % 2).alias("lab"))
    pieces = C.relabel_pieces(px, "lab")
    out = C.merge_small_pieces(pieces, 3)
    assert out.count() == 300 * 64
    for df in (pieces, out, C.flagged_clusters(pieces.withColumn("dk", F.col("lab") == 0), "dk", 8)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and ("#" in line)]
        assert all("strategy=merge" in j for j in joins if "(y#" in j or "piece#" in j or "node#" in j or "u#" in j), plan


def test_a_tile_is_as_large_as_its_image():
    grid, at, y0, x0 = C._grid([5, 5, 6], [9, 10, 9], [1, None, 2])
    assert grid.tolist() == [[1, -1], [2, -1]] and (y0, x0) == (5, 9) and grid[at].tolist() == [1, -1, 2]
