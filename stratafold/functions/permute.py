"""Keyed pseudo-random permutations of dense row numbers as plain integer arithmetic.

A shuffle of n rows is a bijection of 0 .. n - 1 chosen by (seed, replicate). It is a Feistel network over the grid a x b of the
smallest such size at or above n; a number that lands on one of the few surplus places walks on until it is back inside. So
nothing is sorted: a row computes its partner's number and looks that row up. Only products below 2 ** 63, masks and remainders
are used, so any SQL engine repeats the same shuffle (``permutation_sql``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

ROUNDS = 6  # an even number, so that the two halves end in their own radix
_MASK = (1 << 31) - 1
_MUL = 1_103_515_245, 1_540_483_477  # odd multipliers below 2 ** 31 that mix the keys
_SPREAD = 48_271, 69_621  # parts the keys of seeds and rounds


def round_keys(rep: int, seed: int = 0) -> list[int]:
    """Two odd 31-bit multipliers for each round."""
    def fold(x, by, mul):
        return ((x ^ (x >> by)) * mul) & _MASK

    s = (rep * _MUL[0] + (seed + 1) * _SPREAD[0]) & _MASK
    for by, mul in ((15, _MUL[1]), (13, _MUL[0]), (16, _MUL[1])):
        s = fold(s, by, mul)
    out = []
    for j in range(2 * ROUNDS):
        u = fold(((s ^ ((j + 1) * _SPREAD[1] * _SPREAD[0] & _MASK)) * _MUL[0]) & _MASK, 15, _MUL[1])
        out.append((u ^ (u >> 14)) | 1)
    return out


def _network(x: np.ndarray, a, b, keys: list[int]) -> np.ndarray:
    high, low = np.divmod(x, a)
    for j in range(ROUNDS):
        k, m = keys[2 * j : 2 * j + 2]
        low, high = high, (low + ((((high * k + m) & _MASK) * m) >> 24)) % (b if j % 2 else a)
    return high * a + low


def permutation(x: np.ndarray, n: np.ndarray, rep: int, seed: int = 0) -> np.ndarray:
    """Places of the numbers ``x`` of sets of ``n`` rows (one size, or one a row)."""
    keys = round_keys(rep, seed)
    a = np.ceil(np.sqrt(n)).astype(np.int64)
    b = -(-n // a)
    if np.ndim(n) and len(n) and (n == n[0]).all():
        n, a, b = n[0], a[0], b[0]
    out = _network(x, a, b, keys)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        at = (lambda v: v[outside] if np.ndim(v) else v)
        out[outside] = _network(out[outside], at(a), at(b), keys)
        outside = outside[out[outside] >= at(n)]
    return out


class Shuffle:
    """``permutation`` of fixed numbers of one set as a function of the replicate.

    What a round adds depends on one half of a number only, so it is tabulated: about sqrt(n) entries a round.
    """

    def __init__(self, x: np.ndarray, n: int, seed: int = 0):
        self.n, self.seed = n, seed
        self.a = int(np.ceil(np.sqrt(np.int64(n))))
        self.b = -(-n // self.a)
        self.high, self.low = np.divmod(x, self.a)

    def tables(self, rep: int) -> list[np.ndarray]:
        keys, out = round_keys(rep, self.seed), []
        for j in range(ROUNDS):
            k, m = keys[2 * j : 2 * j + 2]
            half = np.arange(self.a if j % 2 else self.b, dtype=np.int64)
            out.append(((((half * k + m) & _MASK) * m) >> 24) % (self.b if j % 2 else self.a))
        return out

    def _walk(self, high: np.ndarray, low: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        for j, t in enumerate(tables):
            s = t[high]
            s += low
            over = s - (self.b if j % 2 else self.a)
            low, high = high, np.minimum(s.view(np.uint64), over.view(np.uint64)).view(np.int64)  # a negative one is the larger
        return high * self.a + low

    def places(self, rep: int, step: int = 1 << 14):
        """(slice, places) of consecutive numbers."""
        tables = self.tables(rep)
        for at in range(0, len(self.high), step):
            part = slice(at, at + step)
            out = self._walk(self.high[part], self.low[part], tables)
            outside = np.flatnonzero(out >= self.n)
            while len(outside):
                out[outside] = self._walk(*np.divmod(out[outside], self.a), tables)
                outside = outside[out[outside] >= self.n]
            yield part, out


def permuted(df: DataFrame, number: str, size: str, reps: Sequence[int], name: str = "to", seed: int = 0, drop: bool = False) -> DataFrame:
    """Every row once per replicate (column ``rep``) with the place ``name`` of row ``number`` (from 0) of ``size`` rows; ``drop``
    leaves those two columns out.

    Numbers and sizes may count inside groups. The rows of a batch stay the same arrays in every replicate, only the places are
    computed, and nothing is shuffled. As column expressions the rounds exceed what the JVM compiles in one method.
    """
    reps = list(reps)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(number), np.int64)
            n = np.asarray(b.column(size), np.int64)
            own = [b.column(f.name) for f in kept]
            for r in reps:
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(x), r, np.int32)), pa.array(permutation(x, n, r, seed))], names)

    kept = [f for f in df.schema.fields if not (drop and f.name in (number, size))]
    names = [*[f.name for f in kept], "rep", name]
    return df.mapInArrow(run, StructType([*kept, StructField("rep", IntegerType()), StructField(name, LongType())]))


def permutation_sql(source: str, number: str, size: str, rep: str, name: str = "to_", seed: int = 0, steps: int = 7) -> str:
    """The same as a SELECT over ``source`` with all its columns; ``steps`` bounds the walk (the chance to need more is below
    size ** (-steps / 2) a row)."""
    def fold(c, by, mul):
        return f"((xor({c}, {c} >> {by}) * {mul}) & {_MASK})"

    def key(j):
        t = f"((xor(_s3, {(j + 1) * _SPREAD[1] * _SPREAD[0] & _MASK}) * {_MUL[0]}) & {_MASK})"
        u = fold(t, 15, _MUL[1])
        return f"(xor({u}, {u} >> 14) | 1) AS _k{j}"

    def one(x):
        rounds = f"SELECT *, {x} % _a AS _l0, {x} // _a AS _h0 FROM _src"
        for j in range(ROUNDS):
            rounds = (f"SELECT *, _h{j} AS _l{j + 1}, (_l{j} + ((((_h{j} * _k{2 * j} + _k{2 * j + 1}) & {_MASK}) * _k{2 * j + 1}) >> 24)) % {'_a' if j % 2 == 0 else '_b'} AS _h{j + 1} FROM ({rounds})")
        drop = ", ".join(f"_l{j}, _h{j}" for j in range(ROUNDS + 1))
        return f"SELECT * EXCLUDE (_x, {drop}), CASE WHEN _x < _n AND _done THEN _x ELSE _h{ROUNDS} * _a + _l{ROUNDS} END AS _x FROM ({rounds})"

    sql = f"SELECT *, CAST(({number}) AS BIGINT) AS _x, CAST(({size}) AS BIGINT) AS _n, false AS _done, (CAST(({rep}) AS BIGINT) * {_MUL[0]} + {(seed + 1) * _SPREAD[0]}) & {_MASK} AS _s0 FROM {source}"
    for j, (by, mul) in enumerate(((15, _MUL[1]), (13, _MUL[0]), (16, _MUL[1]))):
        sql = f"SELECT *, {fold(f'_s{j}', by, mul)} AS _s{j + 1} FROM ({sql})"
    sql = f"SELECT *, {', '.join(key(j) for j in range(2 * ROUNDS))} FROM ({sql})"
    sql = f"SELECT *, CAST(ceil(sqrt(_n)) AS BIGINT) AS _a FROM ({sql})"
    sql = f"SELECT *, CAST(ceil(_n / _a) AS BIGINT) AS _b FROM ({sql})"
    for _ in range(steps):
        sql = one("_x").replace("_src", f"({sql})")
        sql = f"SELECT * REPLACE (true AS _done) FROM ({sql})"
    helpers = ", ".join(["_x", "_n", "_a", "_b", "_done", "_s0", "_s1", "_s2", "_s3", *[f"_k{j}" for j in range(2 * ROUNDS)]])
    return f"SELECT * EXCLUDE ({helpers}), _x AS {name} FROM ({sql})"
