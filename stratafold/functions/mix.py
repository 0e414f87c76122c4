"""Portable pseudo-random numbers of (seed, replicate, integer key): 31-bit integer arithmetic that any SQL engine repeats.

The key and the replicate are folded on their own and then together twice. Keys are integers; other keys are hashed first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

MASK = (1 << 31) - 1
_MUL = 1_103_515_245, 1_540_483_477  # odd multipliers below 2 ** 31
_PART = 69_621, 48_271, 7_919
TOP = 12  # counts of a Poisson draw above it (chance 6e-11) are cut to TOP + 1


def _fold(x):
    for by, mul in ((15, _MUL[1]), (13, _MUL[0])):
        x = ((x ^ (x >> by)) * mul) & MASK
    return x ^ (x >> 16)


def mix(key: np.ndarray, rep: int, seed: int = 0) -> np.ndarray:
    """Numbers in 0 .. 2 ** 31 - 1 of integer keys in one replicate."""
    k = _fold(((key & MASK) * _MUL[0] + ((key >> 31) & MASK) * _PART[0] + (seed + 1) * _PART[2]) & MASK)
    r = _fold((rep * _MUL[1] + (seed + 1) * _PART[1]) & MASK)
    return _fold((_fold(k ^ r) + r) & MASK)


def mixer(key: np.ndarray, seed: int = 0) -> Callable[[int], np.ndarray]:
    """``mix`` of fixed keys as a function of the replicate. The keys are folded once, and 32-bit words hold all that 31 bits keep."""
    k = _fold(((key & MASK) * _MUL[0] + ((key >> 31) & MASK) * _PART[0] + (seed + 1) * _PART[2]) & MASK).astype(np.uint32)

    def fold(x):
        for by, mul in ((15, _MUL[1]), (13, _MUL[0])):
            x ^= x >> np.uint32(by)
            x *= np.uint32(mul)
            x &= np.uint32(MASK)
        x ^= x >> np.uint32(16)
        return x

    def at(rep: int) -> np.ndarray:
        r = np.uint32(_fold((rep * _MUL[1] + (seed + 1) * _PART[1]) & MASK))
        x = fold(k ^ r)
        x += r
        x &= np.uint32(MASK)
        return fold(x)

    return at


def poisson_counts(h: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of mixed numbers by inversion."""
    out = np.zeros(len(h), np.uint8)
    for t in _STEPS:
        above = h >= t
        if not above.any():
            break
        out += above
    return out


def _keyed(df: DataFrame, key: str) -> Column:
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(key).cast("long"), F.lit(-1)) if whole else F.xxhash64(key)


def drawn_sums(df: DataFrame, key: str, sums: dict[str, Column], reps: Sequence[int], rep: str = "rep", seed: int = 0) -> DataFrame:
    """(rep, sums): every expression summed with the Poisson counts of each replicate as weights; NULLs are left out.

    The sums are added up inside the tasks, batch by batch, so only one row a replicate and task leaves them.
    """
    reps, names = list(reps), list(sums)
    d = df.select(_keyed(df, key).alias("_key"), *[e.cast("double").alias(f"v{i}") for i, e in enumerate(sums.values())])

    def run(batches):
        total, known = np.zeros((len(reps), len(names))), np.zeros(len(names), bool)
        for b in batches:
            v = np.column_stack([b.column(f"v{i}").fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(len(names))])
            known |= [b.column(f"v{i}").null_count < b.num_rows for i in range(len(names))]
            at = mixer(np.asarray(b.column("_key")), seed)
            for i, r in enumerate(reps):
                total[i] += poisson_counts(at(r)).astype(np.float64) @ v
        if known.any():
            cols = [pa.array(total[:, i]) if known[i] else pa.nulls(len(reps), pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int32()), *cols], [rep, *names])

    parts = d.mapInArrow(run, StructType([StructField(rep, IntegerType()), *[StructField(c, DoubleType()) for c in names]]))
    return parts.groupBy(rep).agg(*[F.sum(c).alias(c) for c in names])


BITS = 31  # in one mixed number


def bit_sums(df: DataFrame, key: str, value: str, words: Sequence[int], seed: int = 0) -> DataFrame:
    """(word, j, s): sum of the non-NULL values whose mixed number of the word has bit j set.

    A task keeps one sum for each value of each of the four bytes of a word; the sums of the bits follow from these at its end.
    """
    words = list(words)
    d = df.select(_keyed(df, key).alias("_key"), F.col(value).cast("double").alias("v")).where("v is not null")
    has = (np.arange(256)[:, None] >> np.arange(8)) & 1

    def run(batches):
        total, some = np.zeros((len(words), 1024)), False
        for b in batches:
            some = some or b.num_rows > 0
            v, at, byte = np.repeat(b.column("v").to_numpy(), 4), mixer(np.asarray(b.column("_key")), seed), np.arange(4) * 256
            for i, w in enumerate(words):
                total[i] += np.bincount((at(w).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4) + byte).ravel(), v, 1024)
        if some:
            s = (total.reshape(-1, 4, 256) @ has).reshape(len(words), 32)[:, :BITS]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(words, BITS), pa.int32()), pa.array(np.tile(np.arange(BITS), len(words)), pa.int32()), pa.array(s.ravel())], ["word", "j", "s"])

    return d.mapInArrow(run, "word int, j int, s double").groupBy("word", "j").agg(F.sum("s").alias("s"))


def draws(df: DataFrame, key: str, reps: Sequence[int], name: str = "h", rep: str = "rep", seed: int = 0, poisson: bool = False) -> DataFrame:
    """Every row once per replicate (column ``rep``) with its mixed number, or with ``poisson`` its Poisson(1) count by inversion
    (bootstrap multiplicity). The rows of a batch stay the same arrays in every replicate, and nothing is shuffled: hand over the
    columns that are needed only."""
    reps = list(reps)
    d = df.withColumn("_key", _keyed(df, key))

    def run(batches):
        for b in batches:
            own = b.select(names[:-2])
            k = np.asarray(b.column("_key"))
            for r in reps:
                h = mix(k, r, seed)
                if poisson:
                    h = np.searchsorted(levels, h / float(1 << 31), side="right").astype(np.float64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(k), r, np.int32)), pa.array(h)], names)

    names, levels = [*df.columns, rep, name], [level for _, level in _levels()]
    return d.mapInArrow(run, StructType([*df.schema.fields, StructField(rep, IntegerType()), StructField(name, DoubleType() if poisson else LongType())]))


def mixed_sql(source: str, rep: str, key: str, name: str = "h", seed: int = 0) -> str:
    """The same as a SELECT over ``source`` with all its columns."""
    def fold(c, sql):
        sql = f"SELECT * REPLACE ((xor({c}, {c} >> 15) * {_MUL[1]}) & {MASK} AS {c}) FROM ({sql})"
        sql = f"SELECT * REPLACE ((xor({c}, {c} >> 13) * {_MUL[0]}) & {MASK} AS {c}) FROM ({sql})"
        return f"SELECT * REPLACE (xor({c}, {c} >> 16) AS {c}) FROM ({sql})"

    k, r = f"CAST({key} AS BIGINT)", f"CAST({rep} AS BIGINT)"
    sql = (f"SELECT *, (({k} & {MASK}) * {_MUL[0]} + (({k} >> 31) & {MASK}) * {_PART[0]} + {(seed + 1) * _PART[2]}) & {MASK} AS _k, ({r} * {_MUL[1]} + {(seed + 1) * _PART[1]}) & {MASK} AS _r FROM {source}")
    sql = f"SELECT *, xor(_k, _r) AS _x FROM ({fold('_r', fold('_k', sql))})"
    sql = fold("_x", f"SELECT * REPLACE ((_x + _r) & {MASK} AS _x) FROM ({fold('_x', sql)})")
    return f"SELECT * EXCLUDE (_k, _r, _x), _x AS {name} FROM ({sql})"


def _levels() -> list[tuple[int, float]]:
    p = cum = 2.718281828459045 ** -1
    out = [(0, cum)]
    for k in range(1, TOP + 1):
        p /= k
        cum += p
        out.append((k, cum))
    return out


def poisson_weight_sql(h: str) -> str:
    return "CASE " + " ".join(f"WHEN {h} / 2147483648e0 < {level!r} THEN {k}e0" for k, level in _levels()) + f" ELSE {TOP + 1}e0 END"


_STEPS = [np.uint32(math.ceil(level * (1 << 31))) for _, level in _levels()]  # h / 2 ** 31 >= level, in whole numbers
