"""Exact ranks, quantiles and running sums that never put one whole group into one task.

A group may hold a third of all rows, so a plain ``Window.partitionBy(group)`` is not safe.
Every function here first cuts each group into ordered buckets. The bucket edges are a
hash-thinned sample of the ordering values: a pure function of the data, so each re-run of
a lost task sees the same edges, and their number grows with the group. Totals per bucket are
small; a window over them gives each bucket its offset, and only the rows of one bucket are
sorted together.

NULL policy: a NULL key is a group of its own. A NULL ordering value sorts first and keeps its
row. ``value_ranks`` and quantiles look at non-NULL values only; ``average_ranks`` returns every
input row and gives NULL values a NULL rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scalar import col

THIN = 1 << 20  # about one edge per million rows of a group


def _named(order: Sequence) -> list[Column]:
    return [col(o) for o in order]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the key columns of the left side stay."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def _position(edges: Column, value: Column) -> Column:
    """Number of sorted edges at or below the value, by bisection."""
    span = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    mid = lambda s: F.shiftright(s["lo"] + s["hi"], 1)

    def step(s, _):
        right = F.get(edges, mid(s)) <= value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(right, mid(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid(s)).alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(edges) + F.lit(1.0))).cast("int"))
    return F.when(F.size(edges) > 0, F.aggregate(steps, span, step, lambda s: s["lo"])).otherwise(F.lit(0))


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence, thin: int | None = None) -> DataFrame:
    """Adds ``_b``, an ordered bucket number inside each key group."""
    thin = thin or THIN
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_named(order))])
    sample = df.where(F.pmod(F.xxhash64(*_named(order)), F.lit(thin)) == 0)
    edges = sample.groupBy(*keys).agg(F.sort_array(F.collect_set(o)).alias("_e"))
    cut = null_safe_join(df, edges, keys, "left") if keys else df.crossJoin(edges)  # without keys: one row of edges
    return cut.withColumn("_b", F.coalesce(_position(F.col("_e"), o), F.lit(0))).drop("_e")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence, sums: dict[str, Column], thin: int | None = None
) -> DataFrame:
    """Adds ``<name>_before`` (sum over earlier rows of the group) and ``<name>_total``.

    ``order`` must order the rows of a group completely for a repeatable result. The rows are
    shuffled once: bucket totals and row sums read the same exchange.
    """
    keys = list(keys)
    bk = [*keys, "_b"]
    local = W.partitionBy(*bk).orderBy(*_named(order))
    before = local.rowsBetween(W.unboundedPreceding, -1)
    b = bucketed(df, keys, order, thin)
    x = b.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()],
                 *[F.sum(c).over(W.partitionBy(*bk)).alias(f"_t_{n}") for n, c in sums.items()], F.row_number().over(local).alias("_i"))
    totals = x.where("_i = 1").select(*bk, *[f"_t_{n}" for n in sums])
    over_all = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = over_all.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *bk,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(over_all).alias(f"{n}_total") for n in sums],
    )
    return null_safe_join(x, offsets, bk).select(
        *df.columns, *[F.col(f"{n}_total") for n in sums], *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(f"{n}_before") for n in sums])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rn", thin: int | None = None) -> DataFrame:
    """1-based position inside each group, for groups of any size."""
    out = running_sums(df, keys, order, {"_one": F.lit(1).cast("bigint")}, thin)
    return out.withColumn(name, F.col("_one_before") + 1).drop("_one_before", "_one_total")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight=None, thin: int | None = None) -> DataFrame:
    """One row per distinct non-NULL value of a group with its count, weight and running totals.

    Columns: keys, value, n, w, n_before, n_total, w_before, w_total.
    """
    w = F.lit(1.0) if weight is None else col(weight)
    pre = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))
    )
    return running_sums(pre, keys, [value], {"n": F.col("n"), "w": F.col("w")}, thin)


def quantile_terms(value: Column, probs: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over ``value_ranks`` rows and the expressions that turn them into linear-interpolation quantiles of ``value``, a
    rising function of the ranked column. Several functions share one ranking this way."""

    def stat(k: Column) -> Column:
        inside = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, value))

    parts, out = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        parts += [stat(F.floor(pos)).alias(f"_lo_{name}"), stat(F.ceil(pos)).alias(f"_hi_{name}"), F.max(pos - F.floor(pos)).alias(f"_fr_{name}")]
        out.append((F.col(f"_lo_{name}") + F.col(f"_fr_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return parts, out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], thin: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group (one row per group)."""
    parts, out = quantile_terms(F.col(value), probs)
    g = value_ranks(df, keys, value, thin=thin).groupBy(*keys).agg(F.max("n_total").alias("n_total"), *parts)
    return g.select(*keys, "n_total", *out)


def global_quantiles(df: DataFrame, value: str, probs: Sequence[float], thin: int | None = None) -> list[float]:
    """Quantile edges of a whole column; only ``len(probs)`` numbers reach the driver."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = quantiles(df.select(value), [], value, names, thin).first()
    return [row[n] for n in names]


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", thin: int | None = None) -> DataFrame:
    """Adds the average rank (ties share their mean rank) of ``value`` inside each group; NULL for a NULL value."""
    keys = list(keys)
    r = value_ranks(df, keys, value, thin=thin).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(name)
    )
    return null_safe_join(df, r, [*keys, value], "left")


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], thin: int | None = None) -> dict[str, list[float]]:
    """Quantiles of several columns in one job: {column: [values]}."""
    long = df.select(F.expr("stack(%d, %s) as (feature, value)" % (
        len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))))
    names = {f"q{i}": p for i, p in enumerate(probs)}
    got = quantiles(long, ["feature"], "value", names, thin).collect()
    return {r["feature"]: [r[n] for n in names] for r in got}


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weight: str, probs: dict[str, float],
                       thin: int | None = None) -> DataFrame:
    """Quantiles by linear interpolation of the cumulative weight share in value order.

    Rows with equal values enter in order of weight, so the ramp into a value spans its lightest row.
    """
    pre = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
           .agg(F.sum(weight).alias("w"), F.min(weight).alias("w_min")))
    r = running_sums(pre, keys, [value], {"w": F.col("w")}, thin)
    aggs = []
    for name, p in probs.items():
        t = F.col("w_total") * float(p)
        hit = (F.col("w_before") < t) & (t <= F.col("w_before") + F.col("w"))
        frac = F.least(F.lit(1.0), (t - F.col("w_before")) / F.col("w_min"))
        aggs += [F.max(F.when(hit, F.struct(F.col(value).alias("v"), frac.alias("f")))).alias(f"_h_{name}"),
                 F.max(F.when(F.col("w_before") + F.col("w") < t, F.col(value))).alias(f"_p_{name}")]
    g = r.groupBy(*keys).agg(*aggs)
    out = []
    for name in probs:
        v, prev = F.col(f"_h_{name}.v"), F.coalesce(F.col(f"_p_{name}"), F.col(f"_h_{name}.v"))
        out.append((prev + F.col(f"_h_{name}.f") * (v - prev)).alias(name))
    return g.select(*keys, *out)
