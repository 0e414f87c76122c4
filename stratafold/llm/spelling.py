"""Spelling variants by search schemes on FM-indexes of the vocabulary.

Two words are near when one inserted, deleted or replaced code point turns one into the other. Of two halves of a word one is
then left whole, so the search matches a half exactly and goes on across the other half with one error. Words stand between
delimiters, and a state of the search is an interval of suffix ranks.

* **Both directions.** A half is matched from the outer delimiter inwards: the left half to the right, the right half to the
  left. The index therefore exists in two directions, over the vocabulary and over the reversed vocabulary. With a single
  error no scheme turns round, so each keeps the interval of its own direction only.
* **Blocks.** Each direction is cut into ranges of the (reversed) words in order, of about ``BLOCK`` words. One task builds the
  index of one block; a word visits the blocks that its exact half can lie in, nearly always one. A frequent beginning is cut
  into several blocks, and visitors stream past an index, so memory does not grow with either.
* **Each pair once.** A replacement is searched from the word with the smaller symbol, an insertion or deletion from the longer
  word by taking out the last of a run of equal symbols; the place of the error tells which direction finds it. Both words get
  the pair, summed inside the task before anything is shuffled.
* **Index.** Suffixes end at their delimiter (equal ones in order of place). Counts of a symbol before a rank come from a bitmap
  per symbol with running counts, for all words of a length at once.

Words are lower-case runs of letters A-Z and U+00C0 to U+00FF. Defined cases: null and empty texts have no words; a null identifier
counts as the empty string in the check sum; repeated rows count again; one very long text or word is cut only between words;
of equally frequent near words the first in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick, stored

BLOCK = 1 << 15  # words of one index
CHUNK = 1 << 14  # words searched at once
SAMPLE = 1 << 16  # most words that reach the driver to cut blocks; 64 symbols of each
HELD = 250_000  # distinct words that a counting task holds
PIECE = 1 << 20  # bytes of text split at once
SYMBOLS = 91  # the delimiter, a-z, U+00C0 to U+00FF

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[0xC3] = 0xC3  # first byte of U+00C0 to U+00FF
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[0xC0:] = np.arange(27, 91)


def _letters(t: bytes) -> bytes:
    """Lower-case letters of a UTF-8 text, one space for every other byte."""
    buf = np.frombuffer(t, np.uint8)
    out = _LETTER[buf]
    second = np.flatnonzero(buf == 0xC3) + 1
    second = second[second < len(buf)]  # a piece may end inside a symbol; its last word is read again
    out[second] = buf[second]
    return out.tobytes()


def text_words(t: bytes, piece: int = PIECE):
    """Lists of the words of a text, taken from pieces that end between words."""
    lo = 0
    while lo < len(t):
        hi = lo + piece
        part = _letters(t[lo:hi] if hi < len(t) else t[lo:])
        if hi < len(t):
            cut = part.rfind(b" ")
            if cut <= 0:  # one word longer than the piece
                piece *= 2
                continue
            part = part[:cut]
        yield part.split()
        lo += len(part) + (hi < len(t))


def without(word: bytes, at: int) -> bytes:
    """The word less one code point."""
    s = word.decode()
    return (s[:at] + s[at + 1 :]).encode()


def word_counts(docs: DataFrame, shortest: int = 5, damage: int = 0, held: int = HELD) -> DataFrame:
    """(word, n) of all words of ``shortest`` code points or more.

    With ``damage``, every word of a document whose crc32 of ``doc_id:word`` that number divides loses one code point."""

    def run(batches):
        total: Counter[bytes] = Counter()

        def flush():
            kept = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= shortest]
            total.clear()
            words = pa.array([w for w, _ in kept], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    start = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                    for found in text_words(t or b""):
                        for w, n in Counter(found).items():
                            if len(w) < shortest:
                                continue
                            if damage:
                                h = zlib.crc32(w, start)
                                if h % damage == 0:
                                    w = without(w, h % (len(w) - w.count(b"\xc3")))
                            total[w] += n
                        if len(total) > held:
                            yield flush()
        yield flush()

    return pick(docs, "doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index over delimited words that reads them from their beginning: an interval holds the words with one prefix."""

    def __init__(self, words: list[str]):
        text = np.frombuffer("".join(w[::-1] + "\0" for w in words).encode("latin-1"), np.uint8)
        t = _CODE[text]
        m = len(t)
        ends = np.flatnonzero(text == 0)
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=-1))
        left = ends[word] - np.arange(m)  # symbols before the own delimiter
        longest = int(left.max(initial=0))
        key = np.zeros(m, np.uint64)
        padded = np.concatenate([t, np.zeros(8, np.uint8)])
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + m], 0).astype(np.uint64)
        step = 8
        while True:
            order = np.argsort(key, kind="stable")
            if step > longest:
                break
            s = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            ahead = np.minimum(np.arange(m) + step, m - 1)
            key = rank * (m + 1) + np.where(left >= step, rank[ahead] + 1, 0)
            step *= 2
        before = t[order - 1]
        self.rows = len(words)
        self.word_at = word[order[before == 0]]  # words by the rank of their first symbol
        blocks = m // 64 + 1
        bits = np.zeros((SYMBOLS, blocks * 8), np.uint8)
        for c in np.unique(before):
            p = np.packbits(before == c, bitorder="little")
            bits[c, : len(p)] = p
        self.bits = np.ascontiguousarray(bits.view(np.uint64).T)
        ones = np.bitwise_count(self.bits).astype(np.int32)
        self.counts = np.cumsum(ones, axis=0, dtype=np.int32) - ones
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=SYMBOLS))])[:SYMBOLS]
        self.before = before
        self.size = m

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a suffix of lower rank."""
        b = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[b, c] + np.bitwise_count(self.bits[b, c] & mask)

    def step(self, lo, hi, c):
        """Intervals one symbol longer."""
        return self.less[c] + self.rank(c, lo), self.less[c] + self.rank(c, hi)

    def children(self, lo: np.ndarray, hi: np.ndarray):
        """(interval number, symbol, low, high) of all continuations by a letter, ordered by number and symbol."""
        out = []
        short = np.flatnonzero(hi - lo <= 8)
        if len(short):
            width = (hi - lo)[short]
            at = np.repeat(lo[short] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            pair = np.unique(np.repeat(short, width) * SYMBOLS + self.before[at])
            out.append((pair // SYMBOLS, pair % SYMBOLS))
        wide = np.flatnonzero(hi - lo > 8)
        for k in range(0, len(wide), 4096):
            w = wide[k : k + 4096]
            n = [self.counts[i >> 6] + np.bitwise_count(self.bits[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))[:, None]) for i in (lo[w], hi[w])]
            u, c = np.nonzero(n[1] > n[0])
            out.append((w[u], c))
        u = np.concatenate([x[0] for x in out])
        c = np.concatenate([x[1] for x in out])
        order = np.argsort(u * SYMBOLS + c)
        u, c = u[order], c[order]
        u, c = u[c > 0], c[c > 0]
        return u, c, *self.step(lo[u], hi[u], c)


def near_pairs(index: Index, codes: np.ndarray, exact: int, home: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, word of the index) pairs with one error after the first ``exact`` symbols.

    ``codes`` holds words of one length; the error takes a symbol out or puts a greater one in its place. ``home`` marks words of
    the index itself; ``mirrored`` words are read backwards."""
    n, length = codes.shape
    q = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, index.rows, np.int64)
    pool = [np.zeros(0, np.int64)] * 3

    def advance(q, lo, hi, c):
        lo, hi = index.step(lo, hi, c)
        live = lo < hi
        return q[live], lo[live], hi[live]

    for j in range(exact):
        q, lo, hi = advance(q, lo, hi, codes[q, j])
    for j in range(exact, length):
        if len(pool[0]):
            pool = advance(*pool, codes[pool[0], j])
        alone = home[q] & (hi - lo == 1)
        q, lo, hi = q[~alone], lo[~alone], hi[~alone]
        if not len(q):
            if len(pool[0]):
                continue
            break
        c = codes[q, j]
        if mirrored:
            out = codes[q, j - 1] != c if j else np.ones(len(q), bool)
        else:
            out = codes[q, j + 1] != c if j + 1 < length else np.ones(len(q), bool)
        key, inverse = np.unique(lo * (index.size + 1) + hi, return_inverse=True)
        u, symbol, low, high = index.children(key // (index.size + 1), key % (index.size + 1))
        first = np.searchsorted(u, np.arange(len(key) + 1))
        width = np.diff(first)[inverse]
        row = np.repeat(np.arange(len(q)), width)
        at = np.repeat(first[inverse] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        greater = symbol[at] > c[row]
        row, at = row[greater], at[greater]
        pool = [np.concatenate(x) for x in zip(pool, (q[out], lo[out], hi[out]), (q[row], low[at], high[at]))]
        q, lo, hi = advance(q, lo, hi, c)
    zero = np.zeros(len(pool[0]), np.int64)
    a, b = index.rank(zero, pool[1]), index.rank(zero, pool[2])
    hit = np.flatnonzero(b > a)
    return pool[0][hit], index.word_at[a[hit]]


class _Side:
    """Near-word count and best near word (most frequent, then first) of a list of words."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        order = np.array(sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i])), np.int64)
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))
        self.by_place = order
        self.near = np.zeros(len(words), np.int64)
        self.best: list = [None] * len(words)

    def add(self, own: np.ndarray, other: np.ndarray, side: _Side) -> None:
        if not len(own):
            return
        self.near += np.bincount(own, minlength=len(self.words))
        order = np.lexsort((side.place[other], own))
        own, other = own[order], other[order]
        head = np.concatenate([[True], own[1:] != own[:-1]])
        for i, k in zip(own[head].tolist(), other[head].tolist()):
            new = (-int(side.n[k]), side.words[k])
            if self.best[i] is None or new < self.best[i]:
                self.best[i] = new

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.near).tolist()
        cols = [pa.array([self.words[i] for i in at], pa.string()), pa.array(self.near[at], pa.int64()),
                pa.array([-self.best[i][0] for i in at], pa.int64()), pa.array([self.best[i][1] for i in at], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["word", "near", "best_n", "best"])


def _search(mirrored_from: int, chunk: int):
    """mapInArrow function over rows (block, home, x, n), ordered by block with its home rows first."""

    def run(batches):
        block, index, targets = None, None, None
        homes: list[tuple[str, int]] = []
        queue: list[tuple[str, int]] = []

        def find(rows, home: bool):
            mirrored = block >= mirrored_from
            side = _Side([x[::-1] if mirrored else x for x, _ in rows], np.array([n for _, n in rows], np.int64))
            lengths = np.array([len(x) for x, _ in rows])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                codes = _CODE[np.frombuffer("".join(rows[i][0] for i in at.tolist()).encode("latin-1"), np.uint8)].reshape(len(at), length).astype(np.int64)
                exact = length - length // 2 if mirrored else length // 2
                q, t = near_pairs(index, codes, exact, np.full(len(at), home), mirrored)
                q = at[q]
                side.add(q, t, targets)
                targets.add(t, q, side)
            return side.batch()

        def built():
            nonlocal index, targets
            mirrored = block >= mirrored_from
            index = Index([x for x, _ in homes])
            targets = _Side([x[::-1] if mirrored else x for x, _ in homes], np.array([n for _, n in homes], np.int64))
            for k in range(0, len(homes), chunk):
                yield find(homes[k : k + chunk], True)

        def finish():
            nonlocal index
            if homes:
                if index is None:
                    yield from built()
                if queue:
                    yield find(queue, False)
                yield targets.batch()
            homes.clear()
            queue.clear()
            index = None

        for b in batches:
            for k, home, x, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != block:
                    yield from finish()
                    block = k
                if home:
                    homes.append((x, n))
                elif homes:
                    if index is None:
                        yield from built()
                    queue.append((x, n))
                    if len(queue) >= chunk:
                        yield find(queue, False)
                        queue.clear()
        yield from finish()

    return run


def _cuts(vocabulary: DataFrame, rows: int, block: int, mirrored: bool) -> list[str]:
    """Beginnings of all blocks but the first, from a hash-thinned sample of at most about ``SAMPLE`` words."""
    blocks = -(-rows // block)
    if blocks < 2:
        return []
    thin = max(1, rows // min(SAMPLE, blocks * 32))
    x = F.reverse("word") if mirrored else F.col("word")
    got = sorted(r[0] for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(thin)) == 0).select(F.substring(x, 1, 64)).collect())
    return sorted({got[len(got) * k // blocks] for k in range(1, blocks)}) if got else []


def near_words(vocabulary: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best, best_n) of the words of (word, n) that have a near word."""
    rows = vocabulary.count()
    cuts = [_cuts(vocabulary, rows, block, m) for m in (False, True)]
    right = len(cuts[0]) + 1

    def route(batches):
        for b in batches:
            out: list[tuple] = []
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                half = len(word) // 2
                for mirrored, bounds in enumerate(cuts):
                    x = word[::-1] if mirrored else word
                    prefix = x[: len(word) - half if mirrored else half]
                    own = bisect_right(bounds, x)
                    for k in range(bisect_right(bounds, prefix), bisect_right(bounds, prefix + "\U0010ffff") + 1):
                        out.append((k + mirrored * right, k == own, x, n))
            for at in range(0, len(out), 20_000):
                cols = list(zip(*out[at : at + 20_000]))
                kinds = (pa.int32(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "home", "x", "n"])

    dealt = vocabulary.select("word", "n").mapInArrow(route, "block int, home boolean, x string, n long")
    tasks = max(partitions(vocabulary.sparkSession), right + len(cuts[1]) + 1)
    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block", F.desc("home"), "x")
    found = dealt.mapInArrow(_search(right, chunk), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain. A chain is followed by doubling, so the rounds are few."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(vocabulary: DataFrame, ratio: int = 2, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary (word, n)."""
    v = stored(vocabulary.select("word", "n"), "vocabulary")
    form = F.col("best_n") >= ratio * F.col("n")
    near = v.join(near_words(v, block, chunk), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    near = stored(near, "near-words")
    return near.join(roots(near.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
