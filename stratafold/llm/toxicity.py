"""Toxicity by a small convolutional text classifier in numpy.

A word is the sum of two hashed embeddings, of the whole lower-cased word and of its first four bytes. Filters of width
1, 2 and 3 start at each word of the whole text and of no other, each keeps its maximum, and a logistic unit weighs the maxima. It is
trained by backpropagation through the maxima on a bounded sample of labelled rows (``PER_CLASS`` per label); a fifth of
the sample is held back to shift the scores so that the best cut lies at ``CUT`` and to calibrate one threshold per
language (a language with few calibration rows takes the common one). The score itself sees nothing but the text.

Defined cases: null and empty texts score as texts without words; without rows of both labels every score is the share of
label 1 in the sample, 0.0 if there is none; rows without a language take the common threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick
from .labels import fold, labelled_sample
from .text import as_bytes, document_words, document_prefixes

BITS, DIM, FILTERS, WIDTHS = 18, 12, 12, (1, 2, 3)
PER_CLASS, EPOCHS, CUT = 2000, 4, 0.3
BLOCK = 1 << 14
OUT = FILTERS * len(WIDTHS)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.word = r.normal(0, 0.1, ((1 << BITS) + 1, DIM)).astype(np.float32)
        self.head = r.normal(0, 0.1, ((1 << BITS) + 1, DIM)).astype(np.float32)
        self.word[-1] = self.head[-1] = 0  # the pad between texts
        self.conv = r.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
        self.bias = np.zeros(OUT, np.float32)
        self.out = r.normal(0, 0.3, OUT).astype(np.float32)
        self.out_bias = np.float32(0)
        self.scale, self.shift, self.constant = 1.0, 0.0, None
        self.thresholds: dict[str, float] = {}

    def maps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Filter responses at each word; the ids end with two pads."""
        y = (self.word[a] + self.head[b]) @ self.conv
        n, parts, lo = len(a) - 2, [], 0
        for w in WIDTHS:
            z = y[:n, lo : lo + FILTERS]
            for j in range(1, w):
                z = z + y[j : n + j, lo + j * FILTERS : lo + (j + 1) * FILTERS]
            parts.append(z)
            lo += w * FILTERS
        return np.concatenate(parts, axis=1) if n else np.zeros((0, OUT), np.float32)

    def logits(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of whole texts, in blocks of bounded size. A window that starts on a pad belongs to no text."""
        pad = np.full(2, 1 << BITS, np.int32)
        a = np.concatenate([x for d in docs for x in (d[0], pad)])
        b = np.concatenate([x for d in docs for x in (d[1], pad)])
        first = np.cumsum([0] + [len(d[0]) + 2 for d in docs])
        own = np.ones(len(a), bool)
        own[first[1:] - 1] = own[first[1:] - 2] = False
        top = np.full((len(docs), OUT), -np.inf, np.float32)
        for lo in range(0, len(a) - 2, BLOCK):
            z = self.maps(a[lo : lo + BLOCK + 2], b[lo : lo + BLOCK + 2])
            z[~own[lo : lo + len(z)]] = -np.inf
            i = np.searchsorted(first, lo, side="right") - 1
            j = np.searchsorted(first, lo + len(z), side="left")
            cuts = np.maximum(first[i:j] - lo, 0)
            top[i:j] = np.maximum(top[i:j], np.maximum.reduceat(z, cuts, axis=0))
        top[[not len(d[0]) for d in docs]] = 0  # texts without words
        # summed text by text: a matrix product may round by the number of rows
        return (np.maximum(top + self.bias, 0) * self.out).sum(axis=1) + self.out_bias

    def scores(self, docs) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(docs) + self.shift, -40, 40)))

    def train(self, docs, labels, epochs: int, seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        pad = np.full(2, 1 << BITS, np.int32)
        sq = {k: np.full_like(getattr(self, k), 1e-3) for k in ("word", "head", "conv", "bias", "out")}
        rate = 0.05

        def move(name, at, g):
            s, p = sq[name], getattr(self, name)
            s[at] += g * g
            p[at] -= rate * g / np.sqrt(s[at])

        for _ in range(epochs):
            for i in r.permutation(len(docs)):
                if not len(docs[i][0]):
                    continue
                a, b = (np.append(x, pad) for x in docs[i])
                z = self.maps(a, b)
                at = z.argmax(axis=0)
                pooled = z[at, np.arange(OUT)] + self.bias
                h = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-float(np.clip(h @ self.out + self.out_bias, -30, 30))))
                g = np.float32(p - labels[i])
                if abs(g) < 1e-3:
                    continue
                gh = g * self.out * (pooled > 0)
                ga, gb, rows = [], [], []
                conv = np.zeros_like(self.conv)
                lo = 0
                for k, w in enumerate(WIDTHS):
                    f = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        c = slice(lo + j * FILTERS, lo + (j + 1) * FILTERS)
                        p_ = at[f] + j
                        conv[:, c] = (self.word[a[p_]] + self.head[b[p_]]).T * gh[f]
                        rows.append(p_)
                        ga.append(self.conv[:, c].T * gh[f][:, None])
                    lo += w * FILTERS
                p_, gx = np.concatenate(rows), np.concatenate(ga)
                for name, ids in (("word", a[p_]), ("head", b[p_])):
                    u, back = np.unique(ids, return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, back, gx)
                    total[u == 1 << BITS] = 0
                    move(name, u, total)
                move("conv", slice(None), conv)
                move("bias", slice(None), gh)
                move("out", slice(None), g * h)
                self.out_bias -= np.float32(rate * 0.1 * g)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    shift = np.uint64(64 - BITS)
    return [((w >> shift).astype(np.int32), (p >> shift).astype(np.int32)) for w, p in zip(document_words(texts), document_prefixes(texts, 4))]


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors, a false alarm counting twice."""
    by = np.argsort(logit)
    s, t = logit[by], y[by]
    errors = np.append(0, np.cumsum(t == 1)) + 2 * np.append(np.cumsum((t == 0)[::-1])[::-1], 0)
    edge = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gaps = edge[1:] - edge[:-1]
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(gaps[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS, epochs: int = EPOCHS, cut: float = CUT) -> Network:
    rows = labelled_sample(docs, labels, "toxic", usable, per_class, ["text", "lang"])
    net = Network()
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    lang = np.array([r["lang"] or "" for r in rows])
    x = []
    while rows:  # the driver holds the texts only until they are numbers
        part, rows = rows[:200], rows[200:]
        x += features([(r["text"] or "").encode() for r in part])
    held = np.arange(len(x)) % 5 == 0
    if len(set(y[held].tolist())) < 2:
        held = np.ones(len(x), bool)  # too few rows to hold any back
    train = [i for i in range(len(x)) if not held[i] or held.all()]
    net.train([x[i] for i in train], y[train], epochs)
    at = np.flatnonzero(held)
    logit = np.concatenate([net.logits([x[i] for i in at[lo : lo + 100]]) for lo in range(0, len(at), 100)])
    best, spread = best_cut(logit, y[at]), max(1e-3, float(logit.std()))
    net.scale = 3.0 / spread
    net.shift = float(np.log(cut / (1 - cut))) - net.scale * best
    lang = lang[at]
    net.thresholds[""] = cut
    for name in sorted(set(lang)):
        own = lang == name
        if name and y[at][own].sum() >= 20 and (1 - y[at][own]).sum() >= 20:
            v = net.scale * best_cut(logit[own], y[at][own]) + net.shift
            net.thresholds[name] = float(1 / (1 + np.exp(-v)))
    return net


def score(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The kept columns with ``score`` in 0..1 and ``flagged``: the score reaches the threshold of the row's language."""
    d = pick(docs, *dict.fromkeys(["text", "lang", *keep]))
    shared = d.sparkSession.sparkContext.broadcast(net)  # 2 * 2 ** BITS * DIM numbers
    names = [*keep, "score", "flagged"]

    def run(batches):
        n = shared.value
        common = n.thresholds.get("", 2.0 if n.constant is not None else CUT)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                v = n.scores(features(as_bytes(s.column(0)))).astype(float)
                cut = np.array([n.thresholds.get(x or "", common) for x in s.column(1).to_pylist()])
                cols = [s.column(s.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(v, pa.float64()), pa.array(v >= cut)], names)

    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keep)
    return d.mapInArrow(run, f"{kinds}, score double, flagged boolean")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged); labels come from rows whose crc32 modulo 4 is not 2."""
    net = fit(docs, labels, fold(4) != 2)
    s = score(docs, net, ["doc_id"])
    return s.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "flagged")
