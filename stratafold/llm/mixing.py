"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the wanted size over its own size. A document's number of
copies inverts the Poisson distribution of that mean at uniform numbers seeded by a hash of (seed, identifier), so it is
the same in every run and on every executor. Large means are sums of independent draws of at most ``STEP``, which keeps
the inverted table short. The copies are dealt over all partitions by a hash and sorted by it: a global shuffle.

Defined cases: sizes count characters, at least one per document; a null source is a source of its own; documents with a
null identifier draw as identifier 'null'; repeated rows draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick, stored, text_or_empty

STEP, TOP = 8.0, 64  # a mean of 8 exceeds 64 with a chance below 1e-35
BROADCAST_SOURCES = 20_000
SALTS = 64


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 48 bits of a hash; any SQL engine with md5 gives the same."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_rates(docs: DataFrame, temperature: float = 0.5, size_factor: float = 1.0, targets: DataFrame | None = None) -> DataFrame:
    """(source, units, rate, parts, cdf). ``targets`` (source, weight) replaces the weights units ** temperature; a source without one gets none."""
    s = docs.groupBy("source").agg(F.sum(F.greatest(F.length(text_or_empty()), F.lit(1)).cast("long")).alias("units"))
    if targets is None:
        s = s.withColumn("weight", F.pow(F.col("units").cast("double"), F.lit(temperature)))
    else:
        t = targets.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        s = s.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "units", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    s = stored(s, "source-units")
    total = s.agg(F.sum("units").alias("units"), F.sum("weight").alias("weight")).first()  # two numbers
    share = F.lit(size_factor) * F.col("weight") / F.lit(total["weight"] or 1.0)
    s = s.withColumn("rate", share * F.lit(float(total["units"] or 0)) / F.col("units"))
    s = s.withColumn("parts", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("a"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["a"], F.array(acc["c"] + p)).alias("a"))

    return s.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TOP)), zero, step, lambda acc: acc["a"]))


def poisson_mix(docs: DataFrame, temperature: float = 0.5, size_factor: float = 1.0, targets: DataFrame | None = None, seed: int = 17,
                columns: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """The named columns of every copy, with ``copy`` (1..count) and ``shuffle_key``, in a globally shuffled order."""
    d = pick(docs, *columns)
    rates = stored(source_rates(d.select("source", "text"), temperature, size_factor, targets), "source-rates")
    cols = [F.col(c) for c in columns]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    r = rates.select(F.col("source").alias("_source"), "parts", "cdf")
    if rates.count() <= BROADCAST_SOURCES:  # one row of at most 66 numbers per source
        j = d.join(F.broadcast(r), F.col("source").eqNullSafe(F.col("_source")))
    else:  # a source may hold a third of all rows: deal each source over many tasks
        r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        j = d.withColumn("_at", salt).join(r, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    draw = lambda k: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("doc_id"), k)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, k: a + draw(k))
    j = j.select(*cols, count.alias("_n")).where("_n > 0").select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("copy"))
    j = j.withColumn("shuffle_key", uniform(F.lit(f"{seed}s"), F.col("doc_id"), F.col("copy")))
    return j.repartition(partitions(d.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


ORACLE = """
with s as (select source, sum(greatest(length(coalesce(text, '')), 1))::bigint as units from documents group by source),
t as (select sum(units) as units, sum(pow(units::double, 0.5)) as weight from s),
r as (select s.source, pow(s.units::double, 0.5) / t.weight * t.units / s.units as rate from s, t),
m as (select source, greatest(ceil(rate / 8.0), 1)::int as parts, rate / greatest(ceil(rate / 8.0), 1) as mean from r),
c as (
  with recursive x as (
    select source, parts, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from m
    union all select source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from x where k < 64)
  select * from x),
u as (select d.doc_id, d.source, ('0x' || substr(md5('17:' || d.doc_id || ':' || j.j), 1, 12))::bigint / 281474976710656.0::double as u
  from documents d join m on d.source is not distinct from m.source cross join lateral (select unnest(range(1, m.parts + 1)) as j) j),
n as (select u.doc_id, count(*) as n from u join c on u.source is not distinct from c.source and c.c <= u.u group by u.doc_id),
e as (select doc_id, unnest(range(1, n + 1)) as copy from n)
select d.doc_id, d.text, d.source, e.copy::bigint as copy,
  ('0x' || substr(md5('17s:' || d.doc_id || ':' || e.copy), 1, 12))::bigint / 281474976710656.0::double as shuffle_key
from documents d join e using (doc_id)
"""
