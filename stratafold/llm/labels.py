"""Bounded samples of labelled documents for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick

LONGEST = 200_000  # characters; longer labelled documents are not fitted on (all documents are scored whole)


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the identifier's decimal text modulo a small number."""
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, columns: list[str], seed: int = 5) -> list:
    """At most ``per_class`` documents of each label, chosen by a hash of their identifiers, collected to the driver.

    Bound: 2 * per_class rows of at most LONGEST characters.
    """
    known = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    short = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = short[0].unionByName(short[1])
    d = pick(docs, "doc_id", *columns).where(F.length("text") <= LONGEST)
    rows = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *columns).collect()  # chosen: at most 2 * per_class numbers
    return sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
