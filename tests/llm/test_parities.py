"""Parities of n-gram sets: no link is ruled out, and a crowd of near copies under the threshold does not become pairs."""

import random
from collections import Counter

import nasty
import numpy as np
from test_dedup import groups

from stratafold.llm import ngram_join


def test_parities_rule_out_no_link():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64)
        for share in (0, 0.02, 0.06, 0.1, 0.14, 0.3):
            fresh = r.integers(0, 1 << 63, len(base)).astype(np.uint64)
            sets.append(np.unique(np.where(r.random(len(base)) < share, fresh, base)[: len(base) - r.integers(0, len(base) // 5 + 1)]))
    size = np.array([len(s) for s in sets])
    bits = np.array([None if k % 17 == 0 else ngram_join.parities(s) for k, s in enumerate(sets)] + [None], object)[:-1]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    far = ngram_join.Unlike(np.arange(len(sets)), size, bits, 80)(i, j)
    for a, b, no in zip(i, j, far):
        if no:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert bits[a] is not None and bits[b] is not None and 100 * both < 80 * (size[a] + size[b] - both)
    assert far.mean() > 0.8  # pairs without parities and near pairs stay


def test_crowds_under_the_threshold_make_few_pairs(spark, monkeypatch):
    r = random.Random(8)
    base, rows = nasty.prose(41, 200).split(), []
    for i in range(120):
        w = list(base)
        for k in r.sample(range(10, 190), 3):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    made, plain = [], ngram_join.stored

    def stored(df, name):
        out = plain(df, name)
        if name == "ngram-cross":
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, ngram_join.near_groups(d).collect())) == groups(rows)
    assert made[-1] < 1500  # of 7,140 pairs
