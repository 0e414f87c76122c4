"""Boosted trees with monotone signs, grown from gradient histograms.

Columns are cut once into quantile bins. A level of a tree needs one pass: every task adds up gradients and counts by (model, node,
column, bin) with dense array sums, and the sums of the tasks are added element by element, so what reaches the driver depends on
models, nodes, columns and bins only. Splits, bounds and leaf values are chosen there. All outer folds and seeds are models of the
same pass; a model of fold f never sees a row of fold f. Predictions so far are written every few rounds. The table holds
packed blocks of rows, so a pass reads arrays and no single rows, and a tree is applied by one table look-up a column (``Masks``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import column_quantiles
from ..session import written
from .folds import fold_ids

KEEP = 10  # rounds whose trees are applied again in each pass before the predictions are written
BLOCK = 32  # rows in a packed block; an Arrow batch of 10,000 blocks stays at some 10 MB a model and column
SLICE = 1 << 16  # rows worked on at once


@dataclass(frozen=True)
class Settings:
    """``signs``: +1 rising, -1 falling, 0 free, one a column."""

    rounds: int = 700
    depth: int = 4
    rate: float = 0.02
    l2: float = 2.0
    least: int = 15
    rows: float = 0.8
    columns: float = 0.5
    bins: int = 64
    signs: tuple[int, ...] = ()


@dataclass
class Tree:
    """A tree over bin numbers; node k has children 2 k and 2 k + 1, column -1 marks a leaf."""

    depth: int
    column: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 << self.depth
        self.column, self.cut, self.value = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            c = self.column[at]
            inner = np.flatnonzero(c >= 0)
            at[inner] = 2 * at[inner] + (x[inner, c[inner]] > self.cut[at[inner]])
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(x)]


class Masks:
    """A tree of at most four levels as look-ups: a bin of a column says which of the leaves, left to right, are still open.

    A node whose column lies above its cut closes the leaves of its left branch; the first leaf that no column closes is the row's.
    """

    DEPTH = 4
    FIRST = np.array([0] + [(k & -k).bit_length() - 1 for k in range(1, 1 << (1 << DEPTH))], np.uint8)

    def __init__(self, tree: Tree):
        self.open: dict[int, np.ndarray] = {}
        d = tree.depth
        self.node = np.ones(1 << d, np.int64)
        for level in range(d):
            for k in range(1 << level, 2 << level):
                c = int(tree.column[k])
                if c >= 0:
                    span = 1 << (d - level - 1)
                    left = ((1 << span) - 1) << ((k - (1 << level)) * 2 * span)
                    self.open.setdefault(c, np.full(256, (1 << (1 << d)) - 1, np.uint16))[int(tree.cut[k]) + 1 :] &= np.uint16(0xFFFF ^ left)
            inner = tree.column[self.node] >= 0
            self.node = np.where(inner, 2 * self.node + (np.arange(1 << d) >> (d - 1 - level) & 1), self.node)
        self.value = tree.value[self.node]

    def leaves(self, columns: np.ndarray) -> np.ndarray:
        """Number of each row's leaf; the first axis are the columns."""
        out = None
        for c, table in self.open.items():
            out = table[columns[c]] if out is None else out & table[columns[c]]
        return np.zeros(columns.shape[1], np.uint8) if out is None else self.FIRST[out]


def _applied(tree: Tree):
    """(nodes, values) of a tree for arrays whose first axis are the columns."""
    if tree.depth > Masks.DEPTH:
        return lambda x: tree.nodes(x.T), lambda x: tree(x.T)
    m = Masks(tree)
    return lambda x: m.node[m.leaves(x)], lambda x: m.value[m.leaves(x)]


def _packed(a: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of an array as byte strings that end at the given rows."""
    data = np.ascontiguousarray(a)
    at = (ends * (data.nbytes // max(1, len(data)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(c: pa.Array, kind, *width: int) -> np.ndarray:
    """The array whose rows the byte strings hold."""
    c = c.cast(pa.binary())
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
    data = c.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if ends[-1] > ends[0] else b""
    return np.frombuffer(data, kind).reshape(-1, *width)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers of row hashes for one draw."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


class Boosting:
    """The models (fold, seed) of one table and the trees grown so far."""

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], s: Settings, seeds: Sequence[int], key: str, fold: str):
        self.s, self.xs, self.depth = s, list(xs), s.depth
        self.signs = np.array(s.signs or (0,) * len(xs))
        self.folds = fold_ids(df, fold)
        self.models = [(f, seed) for f in self.folds for seed in seeds]
        probs = [i / s.bins for i in range(1, s.bins)]
        self.edges = [np.unique([v for v in e if v is not None]) for e in column_quantiles(df, xs, probs).values()]
        self.trees: list[list[Tree]] = [[] for _ in self.models]
        self.since = 0
        n = {r[fold]: (r["n"], r["t"]) for r in df.where(F.col(y).isNotNull()).groupBy(fold).agg(F.count(y).alias("n"), F.sum(y).alias("t")).collect()}
        rest = [[v for k, v in n.items() if k != f] for f, _ in self.models]
        self.base = np.array([sum(t for _, t in v) / max(1, sum(c for c, _ in v)) for v in rest])
        self.gains = np.zeros(len(xs))
        self.key_type = dict(df.dtypes)[key]
        self.table = written(self._binned(df.select(F.col(key).alias("key"), F.array_position(F.array(*[F.lit(f) for f in self.folds]), F.col(fold)).cast("int").alias("fold"),
                                                    F.col(y).cast("double").alias("y"), F.xxhash64(key).alias("h"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)])), "boosting")

    def _binned(self, d: DataFrame) -> DataFrame:
        """Blocks of rows: keys as a list, and folds, targets, hashes, bin numbers (0: missing) and the predictions of all models as bytes."""
        edges, base = self.edges, self.base

        def run(batches):
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x = np.empty((n, len(edges)), np.uint8)
                for i, e in enumerate(edges):
                    v = b.column(f"x{i}").to_numpy(zero_copy_only=False)
                    x[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="right"))
                ends = np.append(np.arange(0, n, BLOCK), n)
                fold = np.nan_to_num(b.column("fold").to_numpy(zero_copy_only=False)).astype(np.int32)
                y = b.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
                h = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
                p = np.broadcast_to(base, (n, len(base)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column("key")), *[_packed(a, ends) for a in (fold, y, h, x, p)]],
                                                 ["key", "fold", "y", "h", "x", "p"])

        return d.mapInArrow(run, f"key array<{self.key_type}>, fold binary, y binary, h binary, x binary, p binary")

    def _scores(self, b) -> np.ndarray:
        """Predictions so far, rows by models."""
        x = _unpacked(b.column("x"), np.uint8, len(self.xs))
        p = _unpacked(b.column("p"), np.float64, len(self.models)).copy()
        trees = [[_applied(t)[1] for t in m] for m in self._recent()]
        for at in range(0, len(x), SLICE):
            xs = x[at : at + SLICE].T.astype(np.intp)
            for m, of in enumerate(trees):
                for t in of:
                    p[at : at + SLICE, m] += t(xs)
        return p

    def _recent(self) -> list[list[Tree]]:
        return [t[self.since :] for t in self.trees]

    def _light(self):
        """What a task needs, without the Spark tables."""
        out = object.__new__(Boosting)
        out.s, out.xs, out.models, out.folds, out.since = self.s, self.xs, self.models, self.folds, 0
        out.trees = self._recent()
        return out

    def _histograms(self, growing: list[Tree], level: int, turn: int, allowed: list[np.ndarray]) -> np.ndarray:
        """Sums of (residual, rows) by model, node of the level, column and bin."""
        me, width = self._light(), self.s.bins + 1
        shape = (len(self.models), 1 << level, len(self.xs), width, 2)
        wanted = [sorted({0, *np.flatnonzero(a)}) for a in allowed]  # column 0 holds the sums of a node

        def run(batches):
            total = np.zeros(shape)
            trees = [[_applied(t)[1] for t in m] for m in me._recent()]
            nodes = [_applied(t)[0] for t in growing]

            def add(x, p, y, fold, h):
                known = ~np.isnan(y)
                drawn = {seed: _uniform(h, seed * 1_000_003 + turn) < me.s.rows if me.s.rows < 1 else known for _, seed in me.models}
                for m, (f, seed) in enumerate(me.models):
                    own = np.flatnonzero(known & (fold != me.folds.index(f)) & drawn[seed])
                    xo = x[:, own].astype(np.intp)
                    at = nodes[m](xo) - (1 << level)
                    score = p[own, m]
                    for t in trees[m]:
                        score += t(xo)
                    g = y[own] - score
                    if len(at) and at.min() < 0:
                        here = at >= 0
                        at, g, xo = at[here], g[here], xo[:, here]
                    at = at * width
                    for c in wanted[m]:
                        k = at + xo[c]
                        total[m, :, c, :, 0] += np.bincount(k, g, shape[1] * width).reshape(shape[1], width)
                        total[m, :, c, :, 1] += np.bincount(k, minlength=shape[1] * width).reshape(shape[1], width)

            for b in batches:
                x, p = _unpacked(b.column("x"), np.uint8, len(me.xs)), _unpacked(b.column("p"), np.float64, len(me.models))
                y, fold, h = _unpacked(b.column("y"), np.float64), _unpacked(b.column("fold"), np.int32) - 1, _unpacked(b.column("h"), np.int64)
                for i in range(0, len(y), SLICE):
                    to = slice(i, i + SLICE)
                    add(np.ascontiguousarray(x[to].T), p[to], y[to], fold[to], h[to])
            flat = total.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["i", "v"])

        out = np.zeros(shape)
        sums = self.table.select("fold", "y", "h", "x", "p").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # bounded by the shape
        out.flat[np.asarray(sums.column("i"))] = np.asarray(sums.column("v"))
        return out

    def _split(self, tree: Tree, node: int, hist: np.ndarray, allowed: np.ndarray, bounds: dict) -> None:
        """Best split of a node or its leaf value; children get values and bounds."""
        s = self.s
        g, n = hist[0, :, 0].sum(), hist[0, :, 1].sum()
        lo, hi = bounds[node]
        worth = lambda g, n, w: 2 * g * w - (n + s.l2) * w * w
        weight = lambda g, n: np.clip(g / np.maximum(n + s.l2, 1e-9), lo, hi)
        gl, nl = np.cumsum(hist[:, :-1, 0], axis=1), np.cumsum(hist[:, :-1, 1], axis=1)
        gr, nr = g - gl, n - nl
        wl, wr = weight(gl, nl), weight(gr, nr)
        gain = worth(gl, nl, wl) + worth(gr, nr, wr) - worth(g, n, weight(g, n))
        legal = (nl >= s.least) & (nr >= s.least) & allowed[:, None] & (self.signs[:, None] * (wr - wl) >= 0)
        gain = np.where(legal, gain, -np.inf)
        c, k = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[c, k] > 1e-12:
            return
        self.gains[c] += gain[c, k]
        tree.column[node], tree.cut[node] = c, k
        left, right = float(wl[c, k]), float(wr[c, k])
        tree.value[2 * node], tree.value[2 * node + 1] = s.rate * left, s.rate * right
        middle = (left + right) / 2
        sign = self.signs[c]
        bounds[2 * node] = (lo, min(hi, middle)) if sign > 0 else (max(lo, middle), hi) if sign < 0 else (lo, hi)
        bounds[2 * node + 1] = (max(lo, middle), hi) if sign > 0 else (lo, min(hi, middle)) if sign < 0 else (lo, hi)

    def grow(self) -> None:
        """One more tree for every model."""
        turn, p = len(self.trees[0]), len(self.xs)
        growing = [Tree(self.depth) for _ in self.models]
        bounds = [{1: (-np.inf, np.inf)} for _ in self.models]
        take = max(1, round(self.s.columns * p))
        allowed = [np.isin(np.arange(p), np.random.default_rng([seed, turn]).permutation(p)[:take]) for _, seed in self.models]
        for level in range(self.depth):
            hist = self._histograms(growing, level, turn, allowed)
            for m in range(len(self.models)):
                for node in range(1 << level, 2 << level):
                    if node in bounds[m]:
                        self._split(growing[m], node, hist[m, node - (1 << level)], allowed[m], bounds[m])
        for m, t in enumerate(growing):
            self.trees[m].append(t)
        if len(self.trees[0]) - self.since >= KEEP:
            self.table = written(self._advanced(), "boosting")
            self.since = len(self.trees[0])

    def _advanced(self) -> DataFrame:
        me = self._light()

        def run(batches):
            for b in batches:
                ends = np.append(0, np.cumsum(pc.list_value_length(b.column("key")).to_numpy()))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], _packed(me._scores(b), ends)], b.schema.names)

        return self.table.mapInArrow(run, self.table.schema)

    def predictions(self) -> DataFrame:
        """(key, pred): mean over the seeds of the models that have not seen the row; rows without a fold get the mean of all."""
        me = self._light()

        def run(batches):
            for b in batches:
                p, fold = me._scores(b), _unpacked(b.column("fold"), np.int32)
                seen = np.array([[k > 0 and f != me.folds[k - 1] for f, _ in me.models] for k in range(len(me.folds) + 1)])
                own = ~seen[fold]
                yield pa.RecordBatch.from_arrays([b.column("key").flatten(), pa.array((p * own).sum(axis=1) / own.sum(axis=1))], ["key", "pred"])

        return self.table.mapInArrow(run, f"key {self.key_type}, pred double")


def crossfit_boosting(df: DataFrame, y: str, xs: Sequence[str], settings: Settings = Settings(), seeds: Sequence[int] = (1,), key: str = "id",
                      fold: str = "fold") -> tuple[DataFrame, list[tuple[str, float]], Boosting]:
    """Out-of-fold boosted trees averaged over seeds (column ``pred``), the columns' shares of the total gain in falling order, and
    the models. Rows with a NULL target are predicted but not learned from; a missing value is the lowest bin."""
    b = Boosting(df, y, xs, settings, seeds, key, fold)
    for _ in range(settings.rounds):
        b.grow()
    share = b.gains / (b.gains.sum() or 1.0)
    return df.join(b.predictions().withColumnRenamed("key", key), key), sorted(zip(b.xs, share.tolist()), key=lambda t: -t[1]), b
