"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest hash of its inner s-mers lies at its first or last place. The choice
depends on the k-mer alone, so an edit moves no anchor elsewhere: equal stretches keep equal anchors at equal distances.
A fingerprint holds the ``SIZE`` anchors with the smallest hashes over the whole text, each with its position; it is of
bounded size and a pure function of the text. Likeness estimates the Jaccard similarity of the two anchor sets from the
bottom of their union; an anchor that both hold counts only if it is placed consistently: its shift from one text to the
other must lie within ``SLACK`` of that of another common anchor, unless it is the only anchor of one of the texts.

Defined cases: null text is empty; a text shorter than k has one anchor, itself; an empty text has none, and two empty
fingerprints are alike (1.0). Rows are ordered by descending identifier, nulls last, rows of one identifier by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick, text_or_empty

K, S, SIZE = 24, 8, 96
SLACK = 7  # code points that small edits between two anchors may shift them against each other
CHUNK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of n values, by doubling: n is a sum of powers of two."""
    base, power, have, out, done = np.uint64(0x9E3779B97F4A7C15), None, x, None, 0
    width, mult = 1, base
    while True:
        if n & width:
            out = have.copy() if out is None else out[: max(0, len(x) - done - width + 1)] * mult + have[done : done + max(0, len(x) - done - width + 1)]
            done += width
        if width * 2 > n:
            return out
        have = have[: max(0, len(have) - width)] * mult + have[width:]
        with np.errstate(over="ignore"):
            mult = mult * mult
        width *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, width = x, 1
    while width * 2 <= w:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = w - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of an array of code points."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = code.astype(np.uint64)
    if n < K:
        x = _mix(x + np.uint64(1))
        weights = _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return _mix((x * weights).sum(keepdims=True) + np.uint64(n)), np.zeros(1, np.int64)
    hashes, places = [], []
    for lo in range(0, n - K + 1, CHUNK):
        part = _mix(x[lo : lo + CHUNK + K - 1] + np.uint64(1))
        small = _mix(_gram(part, S))
        inner = K - S + 1
        least = _sliding_min(small, inner)
        m = len(least)
        at = np.flatnonzero((small[:m] == least) | (small[inner - 1 : inner - 1 + m] == least))
        hashes.append(_mix(_gram(part, K))[at])
        places.append(at + lo)
    return np.concatenate(hashes), np.concatenate(places).astype(np.int64)


def sketch(code: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of smallest hash, each at its first position, in order of hash."""
    h, p = anchors(code)
    if len(h) > 8 * size:
        cut = np.partition(h, 4 * size)[4 * size]  # drops large hashes before the sort
        few = h <= cut
        if len(np.unique(h[few])) >= size:
            h, p = h[few], p[few]
    u, first = np.unique(h, return_index=True)
    return u[:size], p[first[:size]]


def likeness(a: tuple, b: tuple, size: int = SIZE) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = both <= union[-1]
    shift = np.sort((a[1][i] - b[1][j])[inside])
    if min(len(a[0]), len(b[0])) > 1:
        close = np.diff(shift) <= SLACK
        shift = shift[np.append(False, close) | np.append(close, False)] if len(shift) else shift
    return min(1.0, len(shift) / len(union))


def written(s: tuple) -> str:
    """Hash and position of each anchor in hexadecimal."""
    return " ".join(f"{int(h):016x}@{int(p):x}" for h, p in zip(*s))


def sliced(batch: pa.RecordBatch, rows: int = 200):
    """Parts of few rows, so that few texts are Python objects at once."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text."""
    d = pick(docs, key, text).select(key, text_or_empty(text).alias("text"))

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole)):
            out = [written(sketch(code_points(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "fingerprint"])

    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, fingerprint string")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness; see ``queries.op2_syncmers``.

    Each text meets its successor in descending order of identifier. The identifiers are cut into ranges at quantiles;
    each range is sorted in one task, and only the first row of a range travels to the range before it.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cuts = d.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))  # at most n - 1 numbers
    # ranges count upwards in descending order of identifier; null identifiers are the last range
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("doc_id") > c)) if cuts else F.lit(0)
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - above))
    heads = {r["bucket"]: r["head"] for r in d.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # one row per range
    order = sorted(heads)
    ranges = range(len(cuts) + 2)
    head = F.get(F.array(*[F.lit(heads.get(b)).cast("long") for b in ranges]), F.col("bucket"))
    before = {b: order[at - 1] for at, b in enumerate(order)}  # the first range visits the last
    guest = F.when(F.col("doc_id").eqNullSafe(head), F.get(F.array(*[F.lit(before.get(b)).cast("int") for b in ranges]), F.col("bucket")))
    to = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")),
                                 F.when(guest.isNotNull(), F.struct(guest.alias("b"), F.lit(True).alias("g")))))
    dealt = d.select("doc_id", "text", F.inline(to)).repartition(n, "b")
    dealt = dealt.sortWithinPartitions("b", "g", F.desc_nulls_last("doc_id"), "text").select("b", "g", "doc_id", "text")

    def run(batches):
        held, out, last_guest = None, [], None

        def pair(a, b):
            doc, text, code, own = a
            cut = len(code) - len(code) // 3
            edited = np.concatenate([code[:cut], b[2][: len(code) // 3]])
            other = sketch(edited)
            digest = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
            out.append((doc, len(code), digest, written(own), written(other), likeness(own, other), likeness(own, b[3])))

        def batch():
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in (part for whole in batches for part in sliced(whole)):
            for where, is_guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if is_guest and last_guest == where:
                    continue  # rows of one identifier: the first in order is the successor
                code = code_points(text)
                row = (doc, text, code, sketch(code))
                if held is not None:
                    pair(held, row)
                held, last_guest = (None, where) if is_guest else (row, None)
                if len(out) >= 2000:
                    yield batch()
        yield batch()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")
