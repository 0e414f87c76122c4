"""Benchmark windows in documents against a plain scan."""

import hashlib
import re
from collections import Counter

import nasty
import pytest

from stratafold.llm import decontaminate


def words(t):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))


def plain(docs, items, window):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[s : s + window]) for s in range(max(1, len(w) - window + 1)) if w]
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s] == x[0] and w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    if i is not None:
                        found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d, len(w), len(hit), len(found), sha, bool(hit)] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


ITEMS = [(1, nasty.prose(1, 120)[100:400]), (2, nasty.prose(1, 120)[150:300]), (3, "one two"), (3, "voice"), (4, None), (5, ""), (6, "中文"), (None, nasty.prose(3, 60)[:120]), (7, "x" * 300),
         (8, "AB ab AB ab ab ab ab ab ab ab ab ab"), (9, "no such words are in any of these texts at all"), (10, nasty.prose(1, 120)[150:300]), (11, "letter garden seven")]
SCHEMA = "item_id long, text string, TEXT int, doc_id string, h long, win string"


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 1, "clash", 2, "w") for i, t in items], SCHEMA)


BIG = decontaminate.BROADCAST_ROWS


@pytest.mark.parametrize("window,shingle,limit", [(10, 3, BIG), (10, 3, 0), (4, 3, BIG), (2, 3, 0), (10, 1, BIG)])
def test_against_a_scan(spark, window, shingle, limit):
    docs = nasty.table(spark)
    rows = [(r[0], r[1]) for r in docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1").collect()]
    got = decontaminate.digest(decontaminate.find_contamination(docs, benchmark(spark), window, shingle, limit))
    assert result(got) == plain(rows, ITEMS, window)


def test_items_of_full_windows_only(spark):
    items = [x for x in ITEMS if len(words(x[1])) >= 10]
    docs = [(i, t) for i, t in enumerate([nasty.prose(1, 120), " ".join(nasty.prose(1, 120).split()[:30]), "", None, "one two"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_contamination(df, benchmark(spark, items))
    assert result(decontaminate.digest(found)) == plain(docs, items, 10)
    for r in found.collect():
        assert all(a.e < b.s for a, b in zip(r.spans, r.spans[1:]))


def test_empty_tables(spark):
    docs = nasty.table(spark)
    clean = decontaminate.digest(decontaminate.find_contamination(docs, benchmark(spark, [])))
    assert clean.count() == docs.count() and not clean.where("contaminated").count()
    assert decontaminate.find_contamination(nasty.empty(spark), benchmark(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    df = decontaminate.digest(decontaminate.find_contamination(nasty.table(spark), benchmark(spark)))
    assert "Python" not in df._jdf.queryExecution().toString() and "MapInArrow" not in df._jdf.queryExecution().toString()
