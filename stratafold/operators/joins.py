"""Joins: validated keys, lookups, spatial neighbours, nearest fill, exact k nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import hash_uniform
from ..session import written


class KeyViolation(ValueError):
    """A join key that is not unique or not complete."""


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    dup = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if dup:
        raise KeyViolation(f"{what}: duplicate key {tuple(dup[0][k] for k in keys)}")
    return df


def join_tables(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Inner join of wide tables; a column name already present gets the table number as prefix."""
    out = tables[0]
    for k, t in enumerate(tables[1:], 1):
        clash = {c: f"f{k}_{c}" for c in t.columns if c != key and c in out.columns}
        out = out.join(t.withColumnsRenamed(clash), key)
    return out


def one_to_one_left(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left join that fails on duplicate keys on either side and on missing values."""
    require_unique(left, [key], "left")
    require_unique(right, [key], "right")
    out = left.join(right, key, "left")
    if out.where(F.col(value).isNull()).limit(1).count():
        raise KeyViolation(f"missing {value}")
    return out


def split_by_membership(df: DataFrame, gate: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    keys = gate.select(key)
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """N:1 lookup; Spark picks broadcast or sort-merge from the measured size of the table."""
    return df.join(table.select(*keys, *cols), list(keys))


def collapse_points(df: DataFrame, entity: str, y: str, x: str, values: Sequence[str]) -> DataFrame:
    """One row per entity and position with the count, sums and sums of squares of the values.

    Positions lie on a bounded raster, so even an entity with most of the rows keeps at most one
    row per raster position after this map-side combined aggregate.
    """
    return df.groupBy(entity, y, x).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s_{v}") for v in values],
        *[F.sum(F.col(v) * F.col(v)).alias(f"q_{v}") for v in values])


def radius_pair_sums(df: DataFrame, entity: str, y: str, x: str, radius: float, values: Sequence[str] = ()) -> DataFrame:
    """Per entity: number of unordered pairs within ``radius`` and the sum of value products over them.

    Points sharing a position are collapsed first; positions then meet through grid cells of
    the radius' size (own cell and 8 neighbours), an equi-join that never compares far points.
    """
    p = collapse_points(df, entity, y, x, values).withColumns(
        {"gy": F.floor(F.col(y) / radius), "gx": F.floor(F.col(x) / radius)})
    near = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = p.withColumn("o", F.explode(near)).select(
        entity, (F.col("gy") + F.col("o.dy")).alias("gy"), (F.col("gx") + F.col("o.dx")).alias("gx"),
        F.col(y).alias("ya"), F.col(x).alias("xa"), F.col("n").alias("na"), *[F.col(f"s_{v}").alias(f"a_{v}") for v in values])
    right = p.select(entity, "gy", "gx", F.col(y).alias("yb"), F.col(x).alias("xb"), F.col("n").alias("nb"),
                     *[F.col(f"s_{v}").alias(f"b_{v}") for v in values])
    d2 = F.pow(F.col("ya") - F.col("yb"), 2) + F.pow(F.col("xa") - F.col("xb"), 2)
    after = (F.col("ya") < F.col("yb")) | ((F.col("ya") == F.col("yb")) & (F.col("xa") < F.col("xb")))
    pairs = left.join(right, [entity, "gy", "gx"]).where(after & (d2 <= radius * radius))
    far = pairs.groupBy(entity).agg(F.sum(F.col("na") * F.col("nb")).alias("pn"),
                                    *[F.sum(F.col(f"a_{v}") * F.col(f"b_{v}")).alias(f"p_{v}") for v in values])
    same = p.groupBy(entity).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sn"),
        *[F.sum((F.col(f"s_{v}") * F.col(f"s_{v}") - F.col(f"q_{v}")) / 2).alias(f"w_{v}") for v in values])
    out = same.join(far, entity, "left")
    return out.select(entity, (F.col("sn") + F.coalesce("pn", F.lit(0))).cast("bigint").alias("pairs"),
                      *[(F.col(f"w_{v}") + F.coalesce(f"p_{v}", F.lit(0.0))).alias(f"prod_{v}") for v in values])


def grid_field(df: DataFrame, entity: str, y: str, x: str, weight: str, values: Sequence[str], centres: Sequence[tuple[float, float]],
               sigma: float) -> DataFrame:
    """Gaussian x weight means of the values at fixed centres (a literal list of a few dozen points).

    Rows of one position are added up first, so an entity keeps at most one row a raster position; then its positions meet in one task
    and all centres are summed side by side, without a row for each centre.
    """
    p = df.groupBy(entity, y, x).agg(F.sum(weight).alias("_w"), *[F.sum(F.col(weight) * F.col(v)).alias(f"_s{i}") for i, v in enumerate(values)])
    sums, cells = [], []
    for c, (yc, xc) in enumerate(centres):
        near = F.exp(-(F.pow(F.col(y) - F.lit(float(yc)), 2) + F.pow(F.col(x) - F.lit(float(xc)), 2)) / (2 * sigma * sigma))
        sums += [F.sum(near * F.col("_w")).alias(f"w{c}"), *[F.sum(near * F.col(f"_s{i}")).alias(f"s{c}_{i}") for i in range(len(values))]]
        cells.append(F.struct(F.lit(c).alias("c"), *[(F.col(f"s{c}_{i}") / F.col(f"w{c}")).alias(v) for i, v in enumerate(values)]))
    return p.repartition(entity).groupBy(entity).agg(*sums).select(entity, F.inline(F.array(*cells)))


def assign_windows(df: DataFrame, y: str, x: str, size: int, stride: int, n: int) -> DataFrame:
    """Rows (row, by, bx) for every block window that holds the point (at most (size/stride)^2)."""

    def hits(c):
        lo = F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride).cast("int") + 1)
        hi = F.least(F.lit(n - 1), F.floor(F.col(c) / stride).cast("int"))
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return df.withColumn("by", F.explode(hits(y))).withColumn("bx", F.explode(hits(x)))


def adjacency(px: DataFrame, label: str = "lab") -> DataFrame:
    """Right and down neighbours of a dense raster as rows (img, y, x, l1, l2); no join is needed."""
    right = F.lead(label).over(W.partitionBy("img", "y").orderBy("x"))
    down = F.lead(label).over(W.partitionBy("img", "x").orderBy("y"))
    two = px.withColumns({"_r": right, "_d": down})
    return two.select("img", "y", "x", F.col(label).alias("l1"), F.explode(F.array("_r", "_d")).alias("l2")).where("l2 is not null")


def lower_envelope(y: Sequence[int], h: Sequence[int]) -> tuple[list[int], list[int]]:
    """Which of the parabolas (q - y)^2 + h, given in rising order of y, is lowest from which integer q on: (indices, starts).

    Of equal ones the first counts. One pass with a stack: a parabola that the new one overtakes before its own start is never lowest.
    """
    keep: list[int] = []
    start: list[int] = []
    for j in range(len(y)):
        at = None
        while keep:
            i = keep[-1]
            at = (h[j] + y[j] * y[j] - h[i] - y[i] * y[i]) // (2 * (y[j] - y[i])) + 1
            if at > start[-1]:
                break
            keep.pop()
            start.pop()
        start.append(at if keep else -(1 << 62))
        keep.append(j)
    return keep, start


def fill_nearest(px: DataFrame, hole, value: str) -> DataFrame:
    """Holes take the value of the nearest other pixel (ties: lower y, then lower x).

    Exact in two line passes: the nearest along the row, then the lower envelope of the parabolas that these leave in a column. A
    column is gathered once, and its envelope takes one walk down the column.
    """
    open_ = F.when(~hole, F.struct(F.col("x").alias("x"), F.col(value).alias("v")))
    row = W.partitionBy("img", "y").orderBy("x")
    left = F.last(open_, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(open_, ignorenulls=True).over(row.rowsBetween(0, W.unboundedFollowing))
    d = px.withColumns({"_l": left, "_r": right, "_hole": F.coalesce(hole, F.lit(False))})
    take_left = F.col("_r").isNull() | (F.col("x") - F.col("_l.x") <= F.col("_r.x") - F.col("x"))
    d = d.withColumn("_n", F.when(F.col("_l").isNotNull() & take_left, F.col("_l")).otherwise(F.col("_r")))
    cell = F.struct(F.col("y").cast("bigint").alias("y"), F.col("_hole").alias("hole"), F.col(value).alias("own"), F.col("_n.v").alias("v"),
                    F.pow(F.col("x") - F.col("_n.x"), 2).cast("bigint").alias("h"))
    column = d.groupBy("img", "x").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    column = column.select("img", "x", *[F.col(f"c.{k}").alias(k) for k in ("y", "hole", "own", "v", "h")])
    kinds = dict(px.dtypes)

    def run(batches):
        for b in batches:
            out = []
            for y, hole_, own, v, h in zip(*(b.column(c).to_pylist() for c in ("y", "hole", "own", "v", "h"))):
                some = [i for i, k in enumerate(h) if k is not None]
                keep, start = lower_envelope([y[i] for i in some], [h[i] for i in some])
                filled, at = list(own), 0
                for i, q in enumerate(y):
                    if hole_[i] and keep:
                        while at + 1 < len(keep) and start[at + 1] <= q:
                            at += 1
                        filled[i] = v[some[keep[at]]]
                    elif hole_[i]:
                        filled[i] = None
                out.append(filled)
            yield pa.RecordBatch.from_arrays([b.column("img"), b.column("x"), b.column("y"), pa.array(out, b.schema.field("own").type)], ["img", "x", "y", value])

    out = column.mapInArrow(run, f"img {kinds['img']}, x {kinds['x']}, y array<bigint>, {value} array<{kinds[value]}>")
    return out.select("img", "x", F.inline(F.arrays_zip("y", value))).select("img", F.col("y").cast(kinds["y"]).alias("y"), "x", value)


def equal_family_mean(long: DataFrame, key: str, family: str, value: str) -> DataFrame:
    """Every family has the same weight whatever its number of runs."""
    inner = long.groupBy(key, family).agg(F.avg(value).alias("_f"))
    return inner.groupBy(key).agg(F.avg("_f").alias(value))


def member_matrix(long: DataFrame, key: str, member: str, value: str, names: Sequence[str]) -> DataFrame:
    return long.groupBy(key).pivot(member, list(names)).agg(F.first(value))


# ---------------------------------------------------------------- exact k nearest neighbours
LEAF = 256  # rows of a cell that the number of pivots aims at
MOST_PIVOTS = 8192  # vectors kept on the driver; beyond LEAF * MOST_PIVOTS rows the cells grow, the result stays exact
_SLACK = 1e-9


def _distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] - 2 * v @ p.T + (p * p).sum(1)[None], 0))


def _beyond_bisectors(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of every row to the region of every pivot, as far as the bisectors with the other pivots tell."""
    out = np.zeros_like(e)
    apart = _distances(p, p)
    for o in range(len(p)):
        other = apart[o] > 0
        out[:, other] = np.maximum(out[:, other], (e[:, other] ** 2 - e[:, o : o + 1] ** 2) / (2 * apart[o, other]))
    return out


class PivotTree:
    """Two levels of pivots over a vector table. A row belongs to the nearest pivot below its nearest upper pivot, so bisectors
    between pivots bound the cells as well as balls and shells do.

    ``reach`` and ``gap`` are the largest and the smallest distance of a cell's members to its pivot, ``over`` the largest distance
    of the members below an upper pivot to it.
    """

    def __init__(self, pivots: np.ndarray):
        self.upper = pivots[: max(1, math.isqrt(len(pivots)))]
        parent = _distances(pivots, self.upper).argmin(1)
        order = np.argsort(parent, kind="stable")
        self.pivots, parent = pivots[order], parent[order]
        self.first = np.searchsorted(parent, np.arange(len(self.upper) + 1))
        n = len(pivots)
        self.reach, self.gap, self.rows = np.full(n, -np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
        self.over = np.full(len(self.upper), -np.inf)

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, distance to the upper pivot) of every vector."""
        d = _distances(v, self.upper)
        up = d.argmin(1)
        cell, near = np.zeros(len(v), np.int64), np.zeros(len(v))
        for u in np.unique(up):
            own = np.flatnonzero(up == u)
            e = _distances(v[own], self.pivots[self.first[u] : self.first[u + 1]])
            cell[own], near[own] = self.first[u] + e.argmin(1), e.min(1)
        return cell, near, d[np.arange(len(v)), up]

    def visits(self, v: np.ndarray, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells but the own one that may hold a vector within the bound of a row."""
        d, room = _distances(v, self.upper), bound * (1 + _SLACK) + _SLACK
        apart = _beyond_bisectors(d, self.upper)
        out = []
        for u in range(len(self.upper)):
            rows = np.flatnonzero((d[:, u] - self.over[u] <= room) & (apart[:, u] <= room))
            if len(rows):
                cells = slice(self.first[u], self.first[u + 1])
                e = _distances(v[rows], self.pivots[cells])
                hit = (e - self.reach[cells] <= room[rows, None]) & (self.gap[cells] - e <= room[rows, None])
                hit &= _beyond_bisectors(e, self.pivots[cells]) <= room[rows, None]
                r, c = np.nonzero(hit)
                out.append((rows[r], c + self.first[u]))
        r, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return r[c != own[r]], c[c != own[r]]


def pivot_tree(df: DataFrame, rows: int, leaf: int = LEAF) -> tuple[PivotTree, DataFrame]:
    """The tree of a table (id, vec) and its rows with their cells."""
    n = max(1, min(MOST_PIVOTS, rows // leaf))
    picked = df.orderBy(F.xxhash64("id"), "id").limit(n).collect()  # at most MOST_PIVOTS
    tree = PivotTree(np.array([r["vec"] for r in picked], dtype=float).reshape(len(picked), -1))

    def run(it):
        for pdf in it:
            if len(pdf):
                cell, near, up = tree.assign(np.stack(pdf["vec"].to_numpy()).astype(float))
                yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "cell": cell.astype("int32"), "dp": near, "du": up})

    cells = written(df.mapInPandas(run, "id bigint, vec array<double>, cell int, dp double, du double"), "cells")
    for r in cells.groupBy("cell").agg(F.max("dp").alias("u"), F.min("dp").alias("l"), F.count(F.lit(1)).alias("n"), F.max("du").alias("o")).collect():
        c = r["cell"]
        tree.reach[c], tree.gap[c], tree.rows[c] = r["u"], r["l"], r["n"]
        up = int(np.searchsorted(tree.first, c, side="right")) - 1
        tree.over[up] = max(tree.over[up], r["o"])
    return tree, cells


def _nearest_in_cells(queries: DataFrame, cells: DataFrame, k: int, chunk: int) -> DataFrame:
    """(id, nb, dist): the k nearest members of a cell to each of its visitors (id, vec, cell, bound), none beyond the bound.

    The rows and the visitors of a cell are both cut into blocks of bounded size and meet block by block.
    """
    def blocks(df, name):
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))

    size = F.broadcast(blocks(cells, "nd").join(blocks(queries, "nq"), "cell"))  # one row a cell
    q = queries.join(size, "cell").withColumn("qb", F.floor(hash_uniform("q", F.col("id")) * F.col("nq")).cast("int"))
    q = q.select("id", "vec", "bound", "cell", "qb", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"))
    d = cells.join(size, "cell").withColumn("db", F.floor(hash_uniform("d", F.col("id")) * F.col("nd")).cast("int"))
    d = d.select("id", "vec", "cell", "db", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb")).toDF("nb", "nvec", "ncell", "ndb", "nqb")

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "nb": [], "dist": []}).astype({"id": "int64", "nb": "int64", "dist": "float64"})
        right = right.sort_values("nb")  # a stable sort by distance then leaves ties in order of the identifier
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["nvec"].to_numpy())
        li, ri, room = left["id"].to_numpy(), right["nb"].to_numpy(), left["bound"].to_numpy() * (1 + _SLACK) + _SLACK
        near, ids, rows_ = [], [], max(1, (1 << 21) // b.size)
        for s in range(0, len(a), rows_):
            dist = np.sqrt(((a[s:s + rows_, None, :] - b[None, :, :]) ** 2).sum(-1))
            dist[li[s:s + rows_, None] == ri[None, :]] = np.inf
            best = np.argsort(dist, axis=1, kind="stable")[:, :k]
            near.append(np.take_along_axis(dist, best, axis=1))
            ids.append(ri[best])
        near, ids = np.concatenate(near), np.concatenate(ids)
        out = pd.DataFrame({"id": np.repeat(li, near.shape[1]), "nb": ids.ravel(), "dist": near.ravel()})
        return out[np.isfinite(out["dist"]) & (out["dist"] <= np.repeat(room, near.shape[1]))]

    return q.groupBy("cell", "db", "qb").cogroup(d.groupBy("ncell", "ndb", "nqb")).applyInPandas(local, "id bigint, nb bigint, dist double")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(W.partitionBy("id").orderBy("dist", "nb"))
    return found.withColumn("rank", best.cast("int")).where(F.col("rank") <= k)


SCREENED = 16  # columns from which on knn compares blocks of rows instead of searching a pivot tree
TILE_ROWS = 1 << 13  # rows that are compared at once
ROWS_HELD = 1 << 17  # rows of the table in one task of knn_blocks


def knn_blocks(df: DataFrame, k: int, queries: Column | None = None, held: int | None = None, parts: int | None = None) -> DataFrame:
    """``knn`` for many columns, where no cell can be ruled out: every query meets every different vector once, as blocks of products.

    A task holds one block of at most ``held`` different vectors with the first k + 1 identifiers of each, queries stream past it in
    batches, and only the k nearest of a batch in a block leave it. Products bound the squared distance within their rounding; what
    lies within that bound is measured by differences, so distances and ties are those of the differences. Copies of a vector are
    compared once.
    """
    held = held or ROWS_HELD
    df = written(df.select(F.col("id").cast("bigint").alias("id"), "vec", (F.lit(True) if queries is None else queries).alias("_q")), "vectors")
    first = df.withColumn("_r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k + 1)
    some = df.where("_q").select("vec").distinct().withColumn("_q", F.lit(True))
    first = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    different = written(first.join(some, "vec", "left").select("vec", "ids", F.xxhash64("vec").alias("_h"), F.coalesce("_q", F.lit(False)).alias("_q")), "different")
    blocks = max(1, -(-different.count() // held))
    parts = parts or max(1, -(-2 * df.sparkSession.sparkContext.defaultParallelism // blocks))
    block = F.pmod(F.col("_h"), F.lit(blocks)).cast("int")
    data = different.select("vec", "ids", F.col("ids")[0].alias("q"), F.lit(0).alias("_k"), block.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    asked = different.where("_q").select("vec", F.lit(None).cast("array<bigint>").alias("ids"), F.col("ids")[0].alias("q"), F.lit(1).alias("_k"),
                                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), F.pmod(F.xxhash64("_h"), F.lit(parts)).cast("int").alias("_p"))
    both = data.unionByName(asked).withColumn("_to", (F.col("_b") * parts + F.col("_p")).cast("int"))
    both = both.repartitionById(blocks * parts, F.col("_to")).sortWithinPartitions("_k").select("vec", "ids", "q", "_k")

    def nearest(q, at, v, folded, top, starts, size, ids):
        """The first k + 1 rows by (distance, identifier) of every query of a batch."""
        kind, qn = folded.dtype, (q * q).sum(1)
        # norm - 2 q v of all rows; two of them compare rightly within twice the rounding of a product
        slack = 8 * (q.shape[1] + 8) * np.finfo(kind).eps * (qn + top)
        wide = np.column_stack([q, np.ones(len(q))]).astype(kind)
        bound, rs, cs = None, [], []
        for lo in range(0, len(v), TILE_ROWS):
            low = wide @ folded[lo : lo + TILE_ROWS].T
            if bound is None:  # k + 1 different vectors hold k others
                most = np.partition(low, k, axis=1)[:, k] if low.shape[1] > k else np.full(len(q), np.inf)
                bound = most.astype(float) + 2 * slack
            r, c = np.nonzero(low <= bound[:, None].astype(kind))
            rs.append(r)
            cs.append(c + lo)
        r, c = np.concatenate(rs), np.concatenate(cs)
        dist = np.concatenate([np.sqrt(((q[r[i : i + TILE_ROWS]] - v[c[i : i + TILE_ROWS]]) ** 2).sum(-1)) for i in range(0, len(r), TILE_ROWS)])
        n = size[c]  # each vector stands for its identifiers
        row, d = np.repeat(r, n), np.repeat(dist, n)
        nb = ids[np.repeat(starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.lexsort((nb, d, row))
        row, d, nb = row[order], d[order], nb[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        own = rank <= k
        return at[row[own]], nb[own], d[own]

    def run(batches):
        vs, lists, v = [], [], None
        for b in batches:
            late = np.asarray(b.column("_k")) == 1
            for part, ask in ((b.slice(0, int((~late).sum())), False), (b.slice(int((~late).sum())), True)):
                if not part.num_rows:
                    continue
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float, copy=False)
                if not ask:
                    vs.append(x)
                    lists.append(part.column("ids"))
                    continue
                if not vs:
                    continue
                if v is None:
                    v = np.concatenate(vs)
                    size = np.concatenate([np.asarray(a.value_lengths()) for a in lists])
                    ids, starts, norm = np.concatenate([a.flatten().to_numpy() for a in lists]), np.r_[0, np.cumsum(size)[:-1]], (v * v).sum(1)
                    top = float(np.nanmax(norm, initial=0.0))
                    folded = np.column_stack([-2 * v, norm]).astype(np.float32 if top < 1e30 else np.float64)
                at = np.asarray(part.column("q"))
                for lo in range(0, len(x), 128):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in nearest(x[lo : lo + 128], at[lo : lo + 128], v, folded, top, starts, size, ids)], ["q", "nb", "dist"])

    found = both.mapInArrow(run, "q bigint, nb bigint, dist double")
    # the k + 1 first of all blocks serve every copy of a query, less itself
    top = found.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("dist", "nb"))).where(F.col("_r") <= k + 1)
    top = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("dist", "nb"))).alias("near"))
    near = top.join(different.select(F.col("ids")[0].alias("q"), "vec"), "q").select("vec", "near")
    # a copy beyond the first k + 1 is not listed itself
    out = df.where("_q").select("id", "vec").join(near, "vec").select("id", F.slice(F.filter("near", lambda s: s["nb"] != F.col("id")), 1, k).alias("near"))
    return out.select("id", F.posexplode("near").alias("_r", "s")).select("id", F.col("s.nb").alias("nb"), F.col("s.dist").alias("dist"), (F.col("_r") + 1).cast("int").alias("rank"))


def knn(df: DataFrame, k: int, leaf: int = LEAF, chunk: int = 4096, visited: list | None = None, queries: Column | None = None) -> DataFrame:
    """Exact k nearest other rows of every row: (id, nb, dist, rank), ties by lower neighbour id.

    Input ``id bigint, vec array<double>``. A row first searches its own cell of the pivot tree, which bounds its k-th distance;
    then it visits just those cells that balls, shells and bisectors cannot rule out at that bound. ``visited`` receives the number of
    pairs of rows that were compared. ``queries`` (of id) limits the rows that search, not those found. From ``SCREENED`` columns on
    the cells exclude nothing, and every visit would carry its vector: ``knn_blocks`` compares all there.
    """
    wide = df.select(F.size("vec").alias("n")).first()
    if queries is not None or wide is not None and wide["n"] >= SCREENED:
        return knn_blocks(df, k, queries)
    df = written(df.select(F.col("id").cast("bigint").alias("id"), "vec"), "vectors")
    if df.isEmpty():
        return df.select("id", F.lit(0).cast("bigint").alias("nb"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    tree, cells = pivot_tree(df, df.count(), leaf)
    far = F.lit(float("inf"))
    own = written(_best(_nearest_in_cells(cells.select("id", "vec", "cell", far.alias("bound")), cells, k, chunk), k), "own-cell")
    bound = own.where(F.col("rank") == k).select("id", F.col("dist").alias("bound"))
    rows = cells.join(bound, "id", "left").select("id", "vec", "cell", F.coalesce("bound", far).alias("bound"))

    def run(it):
        for pdf in it:
            if len(pdf):
                r, c = tree.visits(np.stack(pdf["vec"].to_numpy()).astype(float), pdf["bound"].to_numpy(), pdf["cell"].to_numpy())
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[r], "vec": pdf["vec"].to_numpy()[r], "cell": c.astype("int32"), "bound": pdf["bound"].to_numpy()[r]})

    visits = written(rows.mapInPandas(run, "id bigint, vec array<double>, cell int, bound double"), "visits")
    if visited is not None:
        more = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        visited.append(int((tree.rows * tree.rows).sum()) + sum(int(tree.rows[c]) * n for c, n in more.items()))
    other = _nearest_in_cells(visits, cells, k, chunk)
    return _best(own.drop("rank").unionByName(other), k)
