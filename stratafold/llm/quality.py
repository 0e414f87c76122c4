"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed 4-grams over byte classes (upper case, lower case, digit, blank, line end, each other sign) and
of markers for immediate and close repetitions of words. Counts are damped, weighted by the inverse document frequency
over all documents and normalised. A truncated singular value decomposition of the labelled sample (``PER_CLASS`` rows per
label) gives the latent space. The labelled vectors go to every task; each block of documents is multiplied with all of
them, and the ``NEIGHBOURS`` largest cosines vote with weights that grow with similarity.

Defined cases: a null or empty text has no features and takes the share of label 1 among the labelled rows, 0.0 if there
are none; with one label only, every score is that label's share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .labels import fold, labelled_sample
from .text import as_bytes, document_words

BITS, RANK, NEIGHBOURS, PER_CLASS = 12, 48, 15, 1500
SIZE = 1 << BITS
REPEATS = 24  # the last features count repetitions
BLOCK = 256


def _classes() -> np.ndarray:
    c = np.arange(256) % 23 + 8  # signs
    c[48:58], c[65:91], c[97:123], c[128:] = 1, 2, 3, 3
    c[32], c[9], c[10], c[13] = 4, 4, 5, 5
    return c.astype(np.uint32)


CLASS = _classes()


def counts(text: bytes, w: np.ndarray) -> np.ndarray:
    """Feature counts of one whole text."""
    out = np.zeros(SIZE, np.float32)
    if len(text) >= 4:
        for lo in range(0, len(text) - 3, 1 << 20):
            c = CLASS[np.frombuffer(text[lo : lo + (1 << 20) + 3], np.uint8)]
            code = ((c[:-3] * 31 + c[1:-2]) * 31 + c[2:-1]) * 31 + c[3:]
            h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out += np.bincount(h % np.uint32(SIZE - REPEATS), minlength=SIZE)
    if len(w) > 1:
        near = [float((w[d:] == w[:-d]).mean()) if len(w) > d else 0.0 for d in (1, 2, 4, 8)]
        share = len(np.unique(w)) / len(w) if len(w) >= 20 else 1.0
        for k, v in enumerate([*near, 1 - share]):  # each share lights as many of its four features as it exceeds steps
            out[SIZE - REPEATS + 4 * k : SIZE - REPEATS + 4 * k + int(np.searchsorted([0.15, 0.3, 0.5, 0.75], v))] = 40
    return out


def batch_counts(column):
    texts = as_bytes(column)
    for t, w in zip(texts, document_words(texts)):
        yield counts(t, w)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of every feature over all documents; the table has SIZE numbers."""

    def run(batches):
        total, n = np.zeros(SIZE, np.int64), 0
        for b in batches:
            for c in batch_counts(b.column(0)):
                total += c > 0
                n += 1
        at = np.append(np.flatnonzero(total), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(total, n)[at], pa.int64())], ["feature", "n"])

    got = pick(docs, "text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # SIZE rows at most
    df = np.zeros(SIZE + 1)
    for r in got:
        df[r["feature"]] = r["n"]
    return np.log((1 + df[SIZE]) / (1 + df[:SIZE])).astype(np.float32) + np.float32(0.1)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Voter:
    def __init__(self, idf, basis, vectors, labels, prior):
        self.idf, self.basis, self.vectors, self.labels, self.prior = idf, basis, vectors, labels, prior

    def latent(self, c: np.ndarray) -> np.ndarray:
        z = weighted(c, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, c: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(c), self.prior)
        sim = self.latent(c) @ self.vectors.T
        k = min(NEIGHBOURS, sim.shape[1])
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sim, at, axis=1), 0) ** 8
        total = w.sum(axis=1)
        vote = (w * self.labels[at]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where((total > 1e-9) & (c.sum(axis=1) > 0), vote, self.prior), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS, seed: int = 6) -> Voter:
    rows = labelled_sample(docs, labels, "quality", usable, per_class, ["text"])
    y = np.array([r["y"] for r in rows], np.float32)
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Voter(None, None, None, None, prior)
    idf = inverse_frequencies(docs)
    texts = [(r["text"] or "").encode() for r in rows]
    c = np.stack([counts(t, w) for t, w in zip(texts, document_words(texts))])
    x = weighted(c, idf)
    q = np.random.default_rng(seed).normal(size=(SIZE, min(RANK + 16, len(x)))).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :RANK].astype(np.float32)
    voter = Voter(idf, basis, None, y, prior)
    voter.vectors = voter.latent(c)
    return voter


def score(docs: DataFrame, voter: Voter, keep: list[str]) -> DataFrame:
    """The kept columns with ``score``: the weighted vote of the nearest labelled texts."""
    d = pick(docs, *dict.fromkeys(["text", *keep]))
    shared = d.sparkSession.sparkContext.broadcast(voter)  # 2 * PER_CLASS vectors of RANK numbers and a SIZE x RANK basis
    names = [*keep, "score"]

    def run(batches):
        v = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                s = b.slice(lo, BLOCK)
                c = np.stack(list(batch_counts(s.column(0))))
                cols = [s.column(s.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(v.scores(c).astype(float), pa.float64())], names)

    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keep)
    return d.mapInArrow(run, f"{kinds}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels come from rows whose crc32 modulo 5 is not 0."""
    s = score(docs, fit(docs, labels, fold(5) != 0), ["doc_id"])
    return s.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
