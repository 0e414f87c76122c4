"""Tokenising, formatting, fingerprints, mixing and classifiers."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import nasty
from stratafold.llm import bpe, chat, labels, mixing, quality, syncmers, toxicity
from stratafold.llm.queries import tokenizer_path
from stratafold.llm.text import document_words, shingles, words


@pytest.fixture(scope="module")
def docs(spark):
    return nasty.table(spark).cache()


def texts(docs):
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("c0", "c1")
    return [(r[0], r[1]) for r in d.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts(docs):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha(ref.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, own).collect())) == want
    got = bpe.decode(bpe.encode(docs, own), own, ["doc_id"])
    assert Counter(map(tuple, got.collect())) == Counter((i, t or "") for i, t in texts(docs))
    assert bpe.encode_checked(docs, own, ["doc_id"]).where("exact").count() == len(texts(docs))


@pytest.mark.parametrize("text", ["a  b   c", " x", "x ", "\n \n\n y", "x\n \ny", "it's we'll DON'T", "a  b", "  z", "1234 ½²", "a" * 3000, "\x1c \x85 q", "  "])
def test_bpe_white_space(text):
    from tokenizers import Tokenizer

    ref, own = Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer.from_file(tokenizer_path())
    assert own.ids(text) == ref.encode(text, add_special_tokens=False).ids and own.decode(own.ids(text)) == text


def turns(spark):
    rows = [
        (1, 0, "system", "be\\1 brief"), (1, 1, "user", "</s>[TURN]x"), (1, 2, "assistant", "[TEXT]\\<\\"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (1, 5, "user", "left over"), (2, 0, "user", "no reply"), (3, 0, "assistant", "alone"), (3, 0, "assistant", "alone"), (None, 0, "user", "q"),
        (None, 1, "assistant", "r"), (4, 1, None, "no role"), (4, 0, "assistant", "中🙂"),
    ]
    return rows, spark.createDataFrame([(*r, "clash", "x") for r in rows], "conv_id long, turn long, role string, text string, segment string, k string")


def test_chat(spark):
    rows, t = turns(spark)
    ex = chat.prefix_target_examples(t)
    convs = defaultdict(list)
    for c, n, role, text in rows:
        convs[c].append((n, role or "", text or ""))
    full = {(r.conv_id, r.example): r for r in chat.expand(ex).collect()}
    want, n_examples = set(), 0
    for c, x in convs.items():
        x.sort()
        loss, chars, said = "", 0, ""
        k = 0
        for _, role, text in x:
            said += f"[TURN]{esc(role)}[TEXT]{esc(text)}</s>"
            if role == "assistant":
                e = full[c, k]
                assert e.text == said and chat.unescape(e.text[e.mask_start : e.mask_end]) == text
                k, loss, chars, n_examples = k + 1, loss + text, chars + len(said), n_examples + 1
        want.add((c, len(x), sha("".join(f"{r}\n{s}\n" for _, r, s in x).encode()), len(loss), sha(loss.encode()), chars))
    assert len(full) == n_examples
    assert set(map(tuple, chat.read_back(ex).collect())) == want
    assert chat.read_back(chat.prefix_target_examples(t.limit(0))).count() == 0


@pytest.mark.parametrize("block", [1, 60, 1000])
def test_chat_reads_written_examples(spark, block):
    rows = [(c, n, ("user", "assistant")[n % 2 or c == 2], f"{'<[' * (n % 3)}turn {n} of {c}") for c in (1, 2) for n in range(30 + c)] + [(3, 0, "user", "alone")]
    ex = chat.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = defaultdict(list)
    for r in chat.pieces(ex, block).collect():
        got[r.conv_id, r.example].append(r)
    chars = defaultdict(int)
    for c in (1, 2):
        said, k = "", 0
        for _, n, role, text in (r for r in rows if r[0] == c):
            said += f"[TURN]{role}[TEXT]{esc(text)}</s>"
            if role == "assistant":
                parts = sorted(got.pop((c, k)), key=lambda r: r.piece)
                assert "".join(p.text for p in parts) == said and [p.start for p in parts] == [sum(len(q.text) for q in parts[:i]) for i in range(len(parts))]
                assert all(len(p.text) < block + 50 for p in parts)
                assert chat.unescape(said[parts[-1].mask_start : parts[-1].mask_end]) == text
                k, chars[c] = k + 1, chars[c] + len(said)
    assert sorted(got) == [(1, None), (3, None)]
    want = []
    for c in (1, 2, 3):
        own = [r for r in rows if r[0] == c]
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        want.append((c, len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()), len(loss), sha(loss.encode()), chars[c]))
    assert sorted(map(tuple, chat.read_back(ex, block).collect())) == want


def esc(s):
    return s.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2")


def test_syncmers_by_definition():
    x = np.random.default_rng(0).integers(97, 110, 700).astype(np.uint32)
    m = syncmers._mix(x.astype(np.uint64) + np.uint64(1))

    def gram(v):
        r = 0
        for t in v:
            r = (r * 0x9E3779B97F4A7C15 + int(t)) % (1 << 64)
        return int(syncmers._mix(np.array([r], np.uint64))[0])

    small = [gram(m[i : i + syncmers.S]) for i in range(len(x) - syncmers.S + 1)]
    inner = syncmers.K - syncmers.S
    want = [i for i in range(len(x) - syncmers.K + 1) if min(small[i : i + inner + 1]) in (small[i], small[i + inner])]
    h, p = syncmers.anchors(x)
    assert p.tolist() == want and h.tolist() == [gram(m[i : i + syncmers.K]) for i in want]


def test_edited_texts(docs):
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.edited_likeness(docs).collect())
    rows = sorted(((i, t or "") for i, t in texts(docs)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        want[i, len(t), sha((t[: len(t) - n] + other[:n]).encode())] += 1
    assert got == want
    one = {r.fingerprint for r in syncmers.fingerprints(docs).where("doc_id in (3, 4)").collect()}
    assert len(one) == 1
    assert syncmers.edited_likeness(nasty.empty(docs.sparkSession)).count() == 0
    single = syncmers.edited_likeness(docs.where("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_likeness_follows_the_share_of_common_text():
    r = np.random.default_rng(7)
    a, b = (r.integers(97, 123, 9000).astype(np.uint32) for _ in range(2))
    near = [syncmers.likeness(syncmers.sketch(a), syncmers.sketch(np.concatenate([a[:n], b[n:]]))) for n in (9000, 6000, 3000, 0)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and abs(near[1] - 0.5) < 0.2 and near[3] < 0.02


def smallest(code):
    """The distinct anchors of smallest hash with their first places."""
    first = {}
    for h, p in zip(*(v.tolist() for v in syncmers.anchors(code))):
        first.setdefault(h, p)
    return sorted(first.items())[: syncmers.SIZE]


def plain_likeness(x, y):
    """By definition, on lists of Python numbers."""
    a, b = dict(smallest(x)), dict(smallest(y))
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted({*a, *b})[: syncmers.SIZE]
    shifts = [a[h] - b[h] for h in union if h in a and h in b]
    alone = min(len(a), len(b)) == 1
    return sum(alone or any(k != m and abs(u - v) <= syncmers.SLACK for m, v in enumerate(shifts)) for k, u in enumerate(shifts)) / len(union)


def test_likeness_by_definition(docs):
    rows = sorted(((i, t or "") for i, t in texts(docs)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    code = [syncmers.code_points(t) for _, t in rows]
    want = Counter()
    for k, (i, t) in enumerate(rows):
        other, n = code[(k + 1) % len(code)], len(t) // 3
        edited = np.concatenate([code[k][: len(t) - n], other[:n]])
        want[i, round(plain_likeness(code[k], edited), 12), round(plain_likeness(code[k], other), 12)] += 1
    assert Counter((r.doc_id, round(r.near_edited, 12), round(r.near_next, 12)) for r in syncmers.edited_likeness(docs).collect()) == want
    written = {" ".join(f"{h:016x}@{p:x}" for h, p in smallest(c)) for c in code}
    assert {r.fingerprint for r in syncmers.fingerprints(docs).collect()} == written


def test_shifts_one_place_apart_agree():
    h = np.arange(1, 9, dtype=np.uint64)
    near = syncmers.likeness((h, np.arange(8) * 100), (h, np.arange(8) * 100 + 7 + np.arange(8) % 2))
    assert near == 1.0  # shifts of seven and eight places
    assert syncmers.likeness((h, np.arange(8) * 100), (h, np.arange(8) * 900)) == 0.0
    assert syncmers.likeness((h[:2], np.array([0, 50])), (h[1:3], np.array([10, 70]))) == 0.0


def test_toxicity_by_a_plain_convolution(spark, docs):
    d, y = training(spark, "toxic")
    net = toxicity.fit(d, y, F.lit(True), per_class=60, epochs=1)
    rows = [(i, t or "") for i, t in texts(docs) if t is None or len(t) < 8000]
    small = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)

    def plain(text):
        a, b = toxicity.features([text.encode()])[0]
        x = [net.word[i].astype(float) + net.head[j] for i, j in zip(a, b)] + [np.zeros(toxicity.DIM)] * 2
        total = float(net.out_bias)
        for f in range(toxicity.OUT):
            k, lo = f // toxicity.FILTERS, toxicity.FILTERS * sum(toxicity.WIDTHS[: f // toxicity.FILTERS])
            taps = [net.conv[:, lo + j * toxicity.FILTERS + f % toxicity.FILTERS] for j in range(toxicity.WIDTHS[k])]
            best = max((sum(float(x[i + j] @ w) for j, w in enumerate(taps)) for i in range(len(a))), default=0.0)
            total += max(best + net.bias[f], 0) * net.out[f]
        return 1 / (1 + np.exp(-(net.scale * total + net.shift)))

    want = sorted((i is None, i or 0, round(plain(t), 3)) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 3)) for r in toxicity.score(small, net, ["doc_id"]).collect())
    assert [w[:2] for w in want] == [g[:2] for g in got] and all(abs(w[2] - g[2]) <= 2e-3 for w, g in zip(want, got))


def test_quality_by_plain_cosines(spark, docs):
    d, y = training(spark, "quality")
    v = quality.fit(d, y, F.lit(True), per_class=40)
    rows = [(k, t or "") for k, (_, t) in enumerate(texts(docs))]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), v, ["doc_id"]).collect()}
    for i, t in rows:
        w = next(iter(document_words([t.encode()])))
        c = quality.counts(t.encode(), w).astype(float)
        x = np.log1p(c) * v.idf
        z = (x / max(np.sqrt((x * x).sum()), 1e-9)) @ v.basis
        z = z / max(np.sqrt((z * z).sum()), 1e-9)
        near = sorted(((float(z @ u), float(label)) for u, label in zip(v.vectors, v.labels)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(s, 0.0) ** 8 for s, _ in near]
        want = sum(a * label for a, (_, label) in zip(weight, near)) / sum(weight) if c.any() and sum(weight) > 1e-9 else v.prior
        assert abs(got[i] - want) < 5e-3, (i, t[:40])


def test_mixing(spark, docs):
    got = mixing.poisson_mix(docs, columns=("doc_id", "text", "source")).collect()
    assert {r.source for r in got} <= {"a", "b", None} and mixing.poisson_mix(nasty.empty(spark)).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("xyz").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") < 30, "tiny").otherwise("rest").alias("source"))
    target = spark.createDataFrame([("big", 1.0), ("rest", 2.0), ("tiny", 1.0)], "source string, weight double")
    sums = {r.source: r.n for r in mixing.poisson_mix(many, targets=target).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, share in (("big", 0.25), ("rest", 0.5), ("tiny", 0.25)):
        assert abs(sums[name] / (20_000 * share) - 1) < 0.06
    again = mixing.poisson_mix(many.repartition(5), targets=target).groupBy("source").count().collect()
    assert {r[0]: r[1] for r in again} == sums


def test_poisson_inversion(spark):
    one = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"))
    n = mixing.poisson_mix(one, size_factor=2.0).groupBy("doc_id").count().groupBy("count").count().collect()
    p = np.exp(-2.0)
    for k, m in ((r[0], r[1]) for r in n if r[0] <= 5):
        want = p * 2.0**k / np.prod(np.arange(1, k + 1)) * 50_000
        assert abs(m - want) < 6 * np.sqrt(want) + 6


def training(spark, label):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        w = [nasty.WORDS[k] for k in rng.integers(0, len(nasty.WORDS), rng.integers(1, 60))]
        y = int(i % 3 == 0)
        if label == "toxic" and y:
            w[rng.integers(0, len(w))] = ("vilexx", "vilezz", "grimuu")[rng.integers(0, 3)]
        if label == "quality" and not y:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", y))
    d = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {label} int")
    return d.drop(label), d.select("doc_id", label)


@pytest.mark.parametrize("label, fit", [("toxic", toxicity.toxicity_scores), ("quality", quality.quality_scores)])
def test_classifiers(spark, docs, label, fit):
    d, y = training(spark, label)
    truth = {r[0]: r[1] for r in y.collect()}
    held = [r for r in fit(d, y).collect() if r.held_out]
    k, m = (4, 2) if label == "toxic" else (5, 0)
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % k == m for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    awkward = docs.drop("part", "h", "rid", "bucket")
    none = y.limit(0)
    for labelled in (none, y.where(f"{label} = 1")):  # no label, one label only
        got = fit(awkward, labelled).collect()
        assert len(got) == len(texts(docs)) and all(0 <= r.score <= 1 for r in got)
    both = docs.select("doc_id").where("doc_id is not null").distinct().withColumn(label, (F.col("doc_id") % 2).cast("int"))
    got = fit(docs, both.unionByName(both)).collect()
    assert len(got) == len(texts(docs)) and all(0 <= r.score <= 1 for r in got)
    assert fit(nasty.empty(spark), y).count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).select("id", labels.fold(4, "id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_words_and_shingles():
    t = "Über  die\tBRÜCKE\x0bgehen wir\nalle Tage".encode()
    big = (b"abc " * 700_000) + b"x" * 1_500_000 + b" end"
    a = next(iter(document_words([t])))
    assert len(a) == 7 and len(np.unique(a)) == 7
    assert next(iter(document_words([t.lower()])))[3] == a[3]
    s, h = words(np.frombuffer(big, np.uint8))
    assert len(s) == 700_002 and len(np.unique(h)) == 3
    assert len(shingles(a, 5)) == 3 and len(shingles(a[:2], 5)) == 1 and len(shingles(a[:0], 5)) == 0


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours(monkeypatch):
    net, r = toxicity.Network(), np.random.default_rng(7)
    net.conv *= 20
    docs = [tuple(r.integers(0, 1 << toxicity.BITS, (2, n)).astype(np.int32)) for n in r.permutation(np.r_[np.zeros(6, int), 1, 1, 2, 2, 3, r.integers(4, 60, 80)])]
    for block in (toxicity.BLOCK, 64):  # a text over several blocks as well
        monkeypatch.setattr(toxicity, "BLOCK", block)
        alone = np.array([net.logits([d])[0] for d in docs])
        assert np.isfinite(alone).all()
        assert np.allclose(net.logits(docs), alone, rtol=0, atol=1e-5)
        assert np.allclose(net.logits(docs[::-1])[::-1], alone, rtol=0, atol=1e-5)
