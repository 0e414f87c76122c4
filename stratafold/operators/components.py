"""Connected components: of rasters, tile by tile, and on graphs of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .joins import adjacency


def sorted_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the pixels. Spark's guess of their size is that of packed files or of rows before they are
    exploded, many times too small, and would send one of them through the driver to every task."""
    return a.join(b.hint("merge"), list(on), how)


def _label(v: np.ndarray, eight: bool) -> np.ndarray:
    """Smallest pixel index of each piece of equal value; -1 for background (negative values)."""
    h, w = v.shape
    lab = np.where(v >= 0, np.arange(h * w).reshape(h, w), -1)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        new = lab.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
            same = (v[a] == v[b]) & (v[a] >= 0)
            m = np.where(same, np.minimum(new[a], new[b]), -1)
            new[a] = np.where(same, m, new[a])
            new[b] = np.where(same, np.minimum(m, new[b]), new[b])
        inside = new >= 0
        new[inside] = new.ravel()[new[inside]]  # follow the label of the label
        if np.array_equal(new, lab):
            return lab
        lab = new


TILE = 256  # pixels along a side of the largest array in a task
_COL = 1 << 32  # a pixel's number is y * _COL + x, so numbers order like (y, x)


def _grid(y, x, v) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], int, int]:
    """Values of one tile on the smallest array around its pixels, with the pixels' places and the array's first row and column."""
    y, x = np.asarray(y, np.int64), np.asarray(x, np.int64)
    y0, x0 = int(y.min()), int(x.min())
    at = y - y0, x - x0
    grid = np.full((at[0].max() + 1, at[1].max() + 1), -1, np.int64)
    grid[at] = [-1 if k is None or k != k else k for k in v]
    return grid, at, y0, x0


def tile_labels(px: DataFrame, value, eight: bool = False, tile: int = TILE) -> DataFrame:
    """(img, y, x, v, label): pieces of equal value inside each tile, named by the number of their first pixel; NULL for background."""
    t = px.select("img", "y", "x", value.cast("int").alias("v"), F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    t = t.groupBy("img", "ty", "tx").agg(F.collect_list(F.struct("y", "x", "v")).alias("p"))
    t = t.select("img", *[F.col(f"p.{c}").alias(c) for c in ("y", "x", "v")])

    def run(batches):
        for b in batches:
            labels = []
            for y, x, v in zip(b["y"], b["x"], b["v"]):
                grid, at, y0, x0 = _grid(y, x, v)
                first = _label(grid, eight)[at]
                name = (y0 + first // grid.shape[1]) * _COL + x0 + first % grid.shape[1]
                labels.append([int(k) if f >= 0 else None for k, f in zip(name, first)])
            yield pd.DataFrame({"img": b["img"], "y": b["y"], "x": b["x"], "v": b["v"], "label": labels})

    kind = dict(px.dtypes)["img"]
    out = t.mapInPandas(run, f"img {kind}, y array<int>, x array<int>, v array<int>, label array<bigint>")
    return out.select("img", F.inline(F.arrays_zip("y", "x", "v", "label")))


def _tile_edges(lab: DataFrame, eight: bool, tile: int) -> DataFrame:
    """Pairs of labels that meet across a tile border with equal value."""
    y, x = F.pmod("y", F.lit(tile)), F.pmod("x", F.lit(tile))
    rim = lab.where(F.col("label").isNotNull() & (y.isin(0, tile - 1) | x.isin(0, tile - 1)))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    left = rim.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in steps])))
    left = left.where((y + F.col("d.y") >= tile) | (x + F.col("d.x") >= tile) | (x + F.col("d.x") < 0))
    left = left.select("img", (F.col("y") + F.col("d.y")).alias("y"), (F.col("x") + F.col("d.x")).alias("x"), "v", F.col("label").alias("a"))
    return sorted_join(left, rim.select("img", "y", "x", "v", F.col("label").alias("b")), ["img", "y", "x", "v"]).select("img", "a", "b").distinct()


def raster_components(px: DataFrame, value, eight: bool = False, tile: int | None = None) -> DataFrame:
    """(img, y, x, comp) of rasters; pixels join when their non-negative values are equal. ``comp`` is the index of the piece's first
    pixel, row by row.

    An image is cut into tiles that are labelled in their own tasks; labels that meet across tile borders are the edges of a graph
    whose components merge them. No task holds more than a tile, and an image of one tile has no edges.
    """
    tile = tile or TILE
    lab = written(tile_labels(px, value, eight, tile), "tiles")
    width = lab.groupBy("img").agg((F.max("x").cast("bigint") + 1).alias("w"))
    edges = written(_tile_edges(lab, eight, tile), "borders")
    if not edges.isEmpty():
        ends = edges.select("img", F.explode(F.array("a", "b")).alias("node")).distinct()
        root = connected_components(ends, edges).select("img", F.col("node").alias("label"), F.col("comp").alias("root"))
        lab = sorted_join(lab, root, ["img", "label"], "left").withColumn("label", F.coalesce("root", "label"))
    first = F.floor(F.col("label") / _COL) * F.col("w") + F.col("label") % _COL
    return lab.join(width, "img").select("img", "y", "x", first.cast("int").alias("comp"))


def component_table(px: DataFrame, comp: DataFrame, least: int, size: int) -> DataFrame:
    """Area, extent and span of every component with at least ``least`` pixels."""
    j = sorted_join(px, comp.where("comp is not null"), ["img", "y", "x"])
    g = j.groupBy("img", "comp").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                                     F.min("v").alias("vmin"), F.var_pop("y").alias("cyy"), F.var_pop("x").alias("cxx"), F.covar_pop("y", "x").alias("cxy"))
    span = ((F.col("y0") == 0) & (F.col("y1") == size - 1)) | ((F.col("x0") == 0) & (F.col("x1") == size - 1))
    return g.where(F.col("area") >= least).withColumn("span", span)


def component_stats(table: DataFrame, size: int) -> DataFrame:
    a = F.col("area").cast("double")
    px = float(size * size)
    return table.groupBy("img").agg(F.count(F.lit(1)).alias("n"), (F.max(a) / px).alias("max_img"), (F.max(a) / F.sum(a)).alias("max_share"),
                                    (F.sum(a * a) / F.sum(a) / px).alias("wmean_img"), F.max(F.col("span").cast("int")).alias("span"),
                                    F.max(F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))).alias("max_ext"))


def blob_table(table: DataFrame, size: int) -> DataFrame:
    """Count, fraction, round / elongated split, mean and largest area, depth of the blobs of each image."""
    a = F.col("area").cast("double")
    half = (F.col("cyy") + F.col("cxx")) / 2
    disc = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("cyy") * F.col("cxx") - F.col("cxy") * F.col("cxy"))))
    asp = 4 * F.sqrt(half + disc) / F.greatest(4 * F.sqrt(F.greatest(F.lit(0.0), half - disc)), F.lit(1.0))
    t = table.withColumn("round", asp < 2.0)
    px = float(size * size)
    return t.groupBy("img").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(a) / px).alias("frac"), F.sum(F.col("round").cast("bigint")).alias("n_round"), F.sum((~F.col("round")).cast("bigint")).alias("n_elong"),
        (F.sum(F.when(F.col("round"), a).otherwise(0.0)) / px).alias("frac_round"), F.avg(a).alias("area_mean"), F.max(a).alias("area_max"), F.avg("vmin").alias("depth"))


def connected_components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = ("img",), node: str = "node") -> DataFrame:
    """Components of an undirected graph of any size: adds ``comp``, the smallest node of the component.

    Alternates two steps on the edge list until it is stable. Large star: every node ties its larger neighbours
    to its smallest neighbour. Small star: every node ties its smaller neighbours to the smallest of them. Both are a
    combining minimum and one inner join whose side of minima has one row per node, so a hub's edges can be split
    over tasks. The edges are written as a table to the shared folder after every round (one job; a checkpoint takes two).
    """
    keys = list(keys)

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def round_(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = sorted_join(both, minima(both), [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = sorted_join(large, minima(large), [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        return tied.unionByName(minima(large).select(*keys, "u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(20,0)"))).first()

    e = edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    def kept(e: DataFrame) -> DataFrame:
        return written(e, "components")

    e = kept(e)
    now = state(e)
    while now[0]:
        e = kept(round_(e))
        before, now = now, state(e)
        if now == before:
            break
    root = e.select(*keys, F.col("u").alias(node), F.col("v").alias("comp"))
    return sorted_join(vertices.select(*keys, node), root, [*keys, node], "left").select(*keys, node, F.coalesce("comp", node).alias("comp"))


def relabel_pieces(px: DataFrame, label: str) -> DataFrame:
    """Connected pieces of equal label; each pixel keeps the attributes of its source label."""
    comp = raster_components(px, F.col(label)).withColumnRenamed("comp", "piece")
    return sorted_join(px, comp, ["img", "y", "x"])


def merge_small_pieces(pieces: DataFrame, least: int) -> DataFrame:
    """Pieces below the size take the label of the large neighbour with the longest contact (ties: lower label)."""
    size = pieces.groupBy("img", "piece").agg(F.count(F.lit(1)).alias("n"))
    big = size.where(F.col("n") >= least).select("img", F.col("piece").alias("b"))
    small = size.where(F.col("n") < least).select("img", F.col("piece").alias("a"))
    touch = adjacency(pieces, "piece").where("l1 <> l2").select("img", F.inline(F.array(
        F.struct(F.col("l1").alias("a"), F.col("l2").alias("b")), F.struct(F.col("l2").alias("a"), F.col("l1").alias("b")))))
    contact = sorted_join(sorted_join(touch, small, ["img", "a"], "left_semi"), big, ["img", "b"], "left_semi").groupBy("img", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    to = contact.groupBy("img", F.col("a").alias("piece")).agg(F.max_by("b", F.struct(F.col("c"), -F.col("b"))).alias("to"))
    return sorted_join(pieces, to, ["img", "piece"], "left").withColumn("piece", F.coalesce("to", "piece")).drop("to")


def flagged_clusters(pieces: DataFrame, flag: str, size: int) -> DataFrame:
    """Clusters of touching flagged regions: count, share of the largest, weighted mean, spanning flag."""
    e = adjacency(pieces.withColumn("_s", F.struct("piece", flag)), "_s").where(
        (F.col("l1.piece") != F.col("l2.piece")) & F.col(f"l1.{flag}") & F.col(f"l2.{flag}"))
    e = e.select("img", F.col("l1.piece").alias("a"), F.col("l2.piece").alias("b")).distinct()
    v = pieces.where(flag).groupBy("img", F.col("piece").alias("node")).agg(
        F.count(F.lit(1)).cast("double").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    cl = sorted_join(connected_components(v, e), v, ["img", "node"])
    c = cl.groupBy("img", "comp").agg(F.sum("area").alias("a"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    span = ((F.col("y0") == 0) & (F.col("y1") == size - 1)) | ((F.col("x0") == 0) & (F.col("x1") == size - 1))
    px = float(size * size)
    return c.groupBy("img").agg(F.count(F.lit(1)).alias("ncluster"), (F.max("a") / px).alias("max_frac"), (F.max("a") / F.sum("a")).alias("max_share"),
                                (F.sum(F.col("a") * F.col("a")) / F.sum("a") / px).alias("wmean"), F.max(span.cast("int")).alias("span"))
