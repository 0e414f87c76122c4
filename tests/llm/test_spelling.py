"""Spelling variants against words compared by their deletions and wildcards."""

import random
import re
import zlib
from collections import Counter, defaultdict

import nasty
import pytest

from stratafold.llm import spelling


def damaged_counts(rows, damage=97):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return out


def groups(counts):
    near = defaultdict(set)
    wild = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            wild[w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in wild.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def result(df):
    got = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}
    assert len(out) == len(got)
    return out


def test_counts_of_awkward_texts(spark):
    docs = nasty.table(spark)
    rows = [(r[0], r[1]) for r in docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1").collect()]
    for damage in (0, 3, 97):
        want = {w: n for w, n in damaged_counts(rows, damage).items() if len(w) >= 5}
        for held in (3, spelling.HELD):
            assert {r.word: r.n for r in spelling.word_counts(docs, 5, damage, held).collect()} == want


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_pieces_end_between_words(piece):
    t = "Éa çb×c ab÷ 中文d ÀÿZ " + "q" * 40 + " end" + "é" * 9
    want = [w.translate(str.maketrans("ABZ", "abz")).encode() for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert [w for part in spelling.text_words(t.encode(), piece) for w in part] == want


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcdeé", 7), ("a", 40)])
@pytest.mark.parametrize("block,chunk", [(7, 5), (60, 16), (1 << 15, 1 << 14)])
def test_groups_of_dense_words(spark, letters, longest, block, chunk):
    r = random.Random(f"{letters}{block}")
    counts = {}
    for _ in range(400):
        counts["".join(r.choice(letters) for _ in range(r.randint(5, longest)))] = r.choice([3, 3, 4, 6, 8, 12, 30, 100])
    v = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert result(spelling.spelling_groups(v, 2, block, chunk)) == groups(counts)


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = damaged_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    want = groups({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    vocabulary = spelling.word_counts(docs, 5, 97).where("n >= 3")
    assert result(spelling.spelling_groups(vocabulary, block=300, chunk=64)) == want
    assert result(spelling.spelling_groups(vocabulary)) == want


def test_long_words_and_empty_tables(spark):
    x = "ab" * 300
    counts = {x: 3, x + "c": 9, x[:-1]: 4, "c" + x: 5, x[:300] + "z" + x[301:]: 3, "short": 3, "shirt": 7}
    v = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.spelling_groups(v, block=3)) == groups(counts)
    assert spelling.spelling_groups(v.limit(0)).count() == 0
    assert spelling.word_counts(nasty.empty(spark)).count() == 0
