"""Exact copies, n-gram groups, repeated strings and repeated lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import nasty
from stratafold.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return nasty.table(spark).cache()


def texts(docs):
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1")
    return [(r[0], r[1]) for r in d.collect()]


def test_exact(docs):
    want = defaultdict(list)
    for i, t in texts(docs):
        want[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == sum(map(len, want.values()))
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for t, ids in want.items():
        group = by[hashlib.sha256(t.encode()).hexdigest()]
        low = min((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in group) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in group} == {(low, len(ids))}
        assert [r.doc_id for r in group if r.kept] == [low]


def test_trie_spills_by_subtree():
    r = random.Random(0)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    trie = exact_dedup.Trie(lambda a, b: a + b, limit=20_000)
    for k in keys:
        trie.add(k, 1)
    assert trie.files
    assert dict(trie.items()) == Counter(keys)


def shingle_sets(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def groups(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i) if i is not None else None) for i, s in sets)


def test_ngram_groups(docs):
    got = Counter(map(tuple, ngram_join.near_groups(docs).collect()))
    assert got == groups(texts(docs))


def test_texts_under_one_identifier_stay(spark):
    rows = [(1, nasty.prose(31, 60), "en", "a", 1), (1, nasty.prose(32, 60), "de", "b", 2), (1, nasty.prose(32, 60), "de", "a", 2), (2, nasty.prose(31, 60) + " end", "en", "a", 3), (3, "", None, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_duplicate_stage(spark, d, "").collect()))
    assert got == Counter([rows[0], rows[2], rows[4]])


def test_ngram_groups_of_chained_copies(spark):
    """A chain whose neighbours are near but whose ends are not, and a crowd of near copies of one text."""
    r = random.Random(5)
    words = nasty.prose(9, 300).split()
    rows, w = [], list(words)
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[r.randrange(len(w))] = f"new{r.random()}"
    for i in range(100, 220):
        w = nasty.prose(11, 200).split()
        w[r.randrange(len(w))] = f"odd{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, ngram_join.near_groups(d).collect())) == groups(rows)


@pytest.mark.parametrize("hot", [2, 7])
def test_ngram_groups_with_hot_lists(spark, hot):
    """Copies and near copies all of whose n-grams lie in more documents than one piece takes."""
    r = random.Random(6)
    base, other = nasty.prose(21, 60).split(), nasty.prose(22, 45).split()
    rows = [(i, " ".join(base)) for i in range(40)] + [(i, " ".join(other)) for i in range(40, 52)]
    for i in range(52, 80):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"odd{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base[k:] + other[:k])) for i, k in enumerate(range(0, 40, 4), 100)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert Counter(map(tuple, ngram_join.near_groups(d, hot=hot).collect())) == groups(rows)


def test_length_and_position_filters_lose_nothing():
    r = np.random.default_rng(1)
    for _ in range(400):
        pool = r.permutation(60).astype(np.uint64)
        a, b = np.sort(pool[: r.integers(1, 50)]), np.sort(r.permutation(pool)[: r.integers(1, 50)])
        both = len(np.intersect1d(a, b))
        near = 100 * both >= 80 * (len(a) + len(b) - both)
        assert ngram_join.linked(a, b, 80) == near
        if near:
            x, y = (a, b) if len(a) <= len(b) else (b, a)
            kx, ky = (len(s) - ngram_join.needed(80, len(s)) + 1 for s in (x, y))
            common = [(int(np.searchsorted(x, g)), int(np.searchsorted(y, g))) for g in np.intersect1d(x[:kx], y[:ky])]
            assert common and all(ngram_join._possible(80, len(x), np.int64(p), len(y), np.int64(q)) for p, q in common)


def test_packed_blobs():
    r = np.random.default_rng(2)
    tok, doc = r.integers(0, 1 << 63, 50).astype(np.uint64), np.sort(r.integers(-5, 5, 50))
    size, pos = (doc * 3 + 50).astype(np.int32), np.arange(50, dtype=np.int32)
    t, d, s, p = ngram_join.unpacked(ngram_join.packed(tok, doc, size, pos))
    assert (t == (tok & np.uint64(0xFFFFFFFF))).all() and (d == doc).all() and (s == size).all() and (p == pos).all()


def cut(rows, n=200):
    seen = Counter(x[i : i + n] for _, x in rows for i in range(len(x) - n + 1))
    out = []
    for i, x in rows:
        mark = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                mark[k : k + n] = b"\1" * n
        kept = bytes(b for b, m in zip(x, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_strings(docs):
    got = Counter(map(tuple, suffix_dedup.digest(docs).collect()))
    rows = [(i, (t or "").encode()) for i, t in texts(docs) if len(t or "") < 50_000]
    long = {i: (t or "").encode() for i, t in texts(docs) if len(t or "") >= 50_000}
    some = Counter({k: v for k, v in got.items() if k[0] not in long})
    assert some == cut(rows)
    sizes = {k[0]: k for k in got if k[0] in long}
    assert sizes[7][2] == len(long[7]) and sizes[8][2] == len(long[7])  # the longer text keeps its tail only
    assert sizes[8][4] == hashlib.sha256(b" tail").hexdigest()


def test_repeated_strings_at_every_distance(spark):
    r = random.Random(3)
    text = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n)).decode()
    shared = text(700)
    rows = [(i, text(r.randint(0, 400)) + shared[r.randint(0, 400) :][: r.randint(150, 320)] + text(r.randint(0, 300))) for i in range(60)]
    rows += [(100, shared), (101, "ab" * 400), (102, "q" * 199), (103, "q" * 200), (104, "z" * 201), (105, text(199))]
    got = Counter(map(tuple, suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == cut([(i, t.encode()) for i, t in rows])


def test_suffix_ranks_keep_the_order():
    r = np.random.default_rng(4)
    a = r.integers(97, 99, (300, 216)).astype(np.uint8)
    a[:, 5:] = 97
    a[::3, 100] = 98
    rank = suffix_dedup.suffix_ranks(a.view(">u8").astype(np.uint64))
    keys = [x.tobytes() for x in a]
    assert rank.tolist() == [sorted(set(keys)).index(k) for k in keys]


def line_rows(rows):
    """Lines that take part: (doc_id, place, words)."""
    out = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            w = [x.strip(line_dedup.MARKS) for x in line.lower().replace("\t", " ").split(" ")]
            if len(line.encode()) > 2 * len(line):
                w = list("".join(w))
            w = [x for x in w if x]
            if w:
                out.append((i, k, " ".join(w)))
    return out


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    r = random.Random(8)
    lines = [" ".join(r.choice(nasty.WORDS) for _ in range(r.randint(5, 60))) for _ in range(40)]
    rows = []
    for i in range(60):
        own = [r.choice(lines) for _ in range(r.randint(0, 6))]
        for k in range(len(own)):
            if r.random() < 0.5:
                w = own[k].split(" ")
                w[r.randrange(len(w))] = f"v{r.randrange(5)}"
                own[k] = " ".join(w).capitalize() + "."
        rows.append((i, "\n".join([*own, f"short {i}", ""])))
    rows += [(100, "好的天气我们去公园散步吧今天\nso it goes\n--\na\tb"), (101, "好的天气我们去公园散步吧明天\nSo it goes!\n--\nA b"), (102, "完全不同的一句话没有相似之处\none two three four\none two three four five")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    parts = line_rows(rows)
    first, parent = {}, {}
    for i, k, w in parts:
        first.setdefault(w, (i, k))
        parent.setdefault(w, w)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(first)
    linked = 0
    for x, a in enumerate(names):
        for b in names[:x]:
            m, n = len(a.split()), len(b.split())
            if min(m, n) >= 0.8 * max(m, n) and edit(a.split(), b.split()) <= max(m, n) // 5:
                parent[find(a)] = find(b)
                linked += 1
    assert linked
    keep = {}
    for i, k, w in parts:
        g = find(w)
        keep[g] = min(keep.get(g, (i, k)), (i, k))
    gone = {(i, k) for i, k, w in parts if keep[find(w)] != (i, k)}
    assert {(101, 0), (101, 1), (101, 3), (102, 2)} <= gone and not gone & {(101, 2), (102, 0)}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(d).collect()} == want


def test_lines_find_every_similar_pair(spark):
    """All pairs of a word edit similarity of 0.8 or more, by brute force; one pair of lines a document."""
    r = random.Random(12)
    rows, want = [], {}
    for i, n in enumerate([*range(5, 31), 40, 63, 100] * 4):
        a = [f"w{r.randrange(10 ** 9)}" for _ in range(n)]
        b = list(a)
        for _ in range(r.randint(1, n // 5 + 1)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [f"v{r.random()}"], [b[k], f"v{r.random()}"], [f"v{r.random()}"]])
        rows.append((i, " ".join(a) + "\n" + " ".join(b)))
        want[i] = " ".join(a) if 5 * edit(a, b) <= max(len(a), len(b)) else rows[-1][1]
    assert 20 < sum(t == want[i] for i, t in rows) < len(rows) - 20
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_lines_of_repeated_rows(spark):
    """Rows that repeat identifier and text keep all lines that repeat no other line."""
    text = [nasty.prose(40 + k, 90).replace("\n", " ") for k in range(3)]
    many = ["\n".join(" ".join(t.split(" ")[k : k + 9]) for k in range(0, 81, 9)) for t in text]
    rows = [(1, many[0]), (1, many[0]), (2, many[1]), (2, many[1]), (None, many[2]), (None, many[2]), (None, many[2])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, line_dedup.dedup_lines(d).collect())) == Counter(rows)


def test_lines_of_awkward_rows(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    d = [(r[0], r[1]) for r in got.collect()]
    assert Counter(i for i, _ in d) == Counter(i for i, _ in texts(docs))
    assert [t for i, t in d if i == 1] == [None] and [t for i, t in d if i == 13] == ["\n\n\n"]
    assert [t for i, t in d if i == 4] == [""] and [t for i, t in d if i == 2] == ["one two"]  # 4 is a copy of 3
    assert [t for i, t in d if i == 15] == [""] and {t for i, t in d if i in (19, 20)} == {"word", ""}


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, ngram_join.near_groups, suffix_dedup.digest, line_dedup.digest])
def test_empty_table(spark, op):
    assert op(nasty.empty(spark)).count() == 0


def test_repeated_rows_of_suffixes_send_each_place_once(spark):
    """A thousand equal rows: every row is a repeat of the others, and the joined lists stay as long as one row's."""
    t = nasty.prose(11, 120)
    n = 1000
    d = spark.createDataFrame([(7, t)] * n + [(8, "unlike " * 3)], "doc_id long, text string").repartition(4)
    packed = suffix_dedup.sampled(d.selectExpr("doc_id as d", "xxhash64(text) as k", "text"), 4)
    shared = suffix_dedup.shared_samples(packed, 4).collect()
    one = {int(q) for q in suffix_dedup.samples(np.frombuffer(t.encode(), np.uint8))[1]}
    assert len(shared) == 1 and len(shared[0].at) == len(one)
    got = suffix_dedup.remove_repeats(d).collect()
    assert sum(r.n_removed == len(t.encode()) and r.n_spans == 1 for r in got) == n and len(got) == n + 1


@pytest.mark.parametrize("numbers", [line_dedup.NUMBERS, 3])
def test_lines_are_compared_by_their_words(spark, monkeypatch, numbers):
    """Words that share a sign are different words: five of five changed words stay far apart even if every sign agrees."""
    monkeypatch.setattr(line_dedup, "NUMBERS", numbers)
    own = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    twins = own.groupBy(line_dedup.word_signs(F.array("w")).alias("s")).agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) > 1")
    pairs = [r.w[:2] for r in twins.orderBy("s").limit(10).collect()]
    a, b = " ".join(p[0] for p in pairs), " ".join(p[1] for p in pairs)
    rows = [(1, a), (2, b), (3, b.replace(pairs[0][1], "other"))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: a, 2: b, 3: ""}


def test_pipeline_stages(spark, tmp_path):
    """Every stage on a small folder of tables against plain rules on what the stage before it kept."""
    r = random.Random(4)
    rows, toxic = [], []
    line = "this same line of words stands in many of the texts"
    for i in range(240):
        t = " ".join(f"{r.choice(nasty.WORDS)}{r.randrange(300)}" for _ in range(30)) + "\n" + line
        if i % 4 == 1:
            t = "vilexx grimuu " + t
        toxic.append((i, int(i % 4 == 1)))
        rows.append((i, t, "en", ("a", "b", None)[i % 3], len(t)))
    rows += [(500 + i, rows[4 * i][1].split("\n")[0] + " tail", "en", "a", 9) for i in range(10)] + [(600, None, None, "a", None), (601, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, kept = str(tmp_path), {}
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.stored(stage(spark, d, sf), f"test-{name}")
        kept[name] = d.collect()
        assert d.columns == list(corpus_pipeline.COLUMNS)
    bad = {i for i, y in toxic if y}
    ids = {name: {x.doc_id for x in k} for name, k in kept.items()}
    assert len(ids["toxicity"] & bad) <= 3 and len({i for i, *_ in rows} - bad - ids["toxicity"]) <= 3
    same = [x.doc_id for x in kept["line_dedup"] if line in (x.text or "")]
    assert same == [min(x.doc_id for x in kept["toxicity"] if line in (x.text or ""))]
    # copies with one word more are lines of their first occurrence: nothing is left of them, and they go
    assert ids["line_dedup"] == {i for i in ids["toxicity"] if not 500 <= i < 600 or 4 * (i - 500) not in ids["toxicity"]}
    assert ids["ngram_join"] == ids["line_dedup"] and ids["mixing"] <= ids["ngram_join"]
    out = corpus_pipeline.STAGES[-1][1](spark, d, sf).collect()
    assert sorted(x.doc_id for x in out) == sorted(x.doc_id for x in kept["mixing"]) and all(x.exact for x in out)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter((x.doc_id, tuple(x.token_ids)) for x in whole) == Counter((x.doc_id, tuple(x.token_ids)) for x in out)


def test_line_keys_meet_every_similar_pair(spark):
    """Lines without any link yet: every similar pair shares enough keys, and a line has no key for each of its words."""
    r = random.Random(21)
    lines, want = [], set()
    for i, n in enumerate([*range(4, 46), 63, 100, 164] * 3):
        a = [f"{r.choice(nasty.WORDS)}{r.randrange(8)}" if i % 3 else r.choice(nasty.WORDS) for _ in range(n)]
        b = list(a)
        for _ in range(max(1, n // 5 - r.randrange(2))):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [f"v{r.random()}"], [b[k], f"v{r.random()}"], [r.choice(nasty.WORDS)]])
        lines += [(2 * i, len(a), " ".join(a)), (2 * i + 1, len(b), " ".join(b))]
        if a != b and max(len(a), len(b)) > 4 and edit(a, b) <= max(len(a), len(b)) // 5 and min(len(a), len(b)) > 3:
            want.add((2 * i, 2 * i + 1))
    d = spark.createDataFrame([x for x in lines if x[1] > 3], "id long, n int, t string")
    keys = line_dedup.line_keys(d)
    per = {x.id: x.c for x in keys.groupBy(F.expr("shiftright(line, 24)").alias("id")).agg(F.count("*").alias("c")).collect()}
    assert all(per[i] <= 2 * (n // 5) + 2 + n // 20 for i, n, _ in lines if n > 3)
    none = spark.createDataFrame([], "node long, comp long")
    got = {tuple(x) for x in line_dedup.cross_pairs(line_dedup.shared_keys(keys), none).collect()}
    assert len(want) > 80 and want <= got


def test_stored_tables_leave_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum("shuffle_" in str(files.getAllFiles().apply(i)) for i in range(files.getAllFiles().size()))
    before = count()
    corpus_pipeline.stored(spark.range(100_000).repartition(4, "id").groupBy(F.col("id") % 1000).count(), "no-shuffles")
    assert count() <= before
