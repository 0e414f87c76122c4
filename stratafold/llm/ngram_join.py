"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. One pass counts in how many documents each n-gram lies, in 2 ** BITS hash buckets (summed per task, one fixed-size
   table). The counts order n-grams from rare to frequent.
2. A document of n n-grams and any partner share one of its first n - ceil(t * n) + 1 n-grams in that order. These prefix
   n-grams go to their part packed in arrays; equal sets of one task send one of them.
3. Posting lists of an n-gram are sorted by set size. Length and positional filters drop pairs that cannot reach the
   threshold. First every document meets a few others only: the heads of its lists, and in a second round members of the
   largest component of its lists, HEADS each time. Verified links join components. Then all pairs of a list whose members still lie in different components are examined. A pair inside a
   component needs no verification, so a group of thousands of near copies never makes all its pairs, and no link between
   components is lost. An n-gram in more than about 2 * HOT documents is dealt to several pieces of its part for the first
   meeting only. Afterwards its list is whole again: members outside its largest component first meet one member of that
   component, then, in cells of about HOT members, every other member.
4. A distinct pair is verified once against the whole sets, after a suffix filter that compares the numbers of n-grams
   between common pivots.
5. Near copies under the threshold never join a component, so all their pairs meet. In lists of more than CROWD members each member
   brings the parities of its n-grams in 3 to 6 buckets an n-gram (``parities``, at most SKETCH bits). Two parities that differ need an n-gram
   that only one set has, so the number of differing bits bounds the symmetric difference from below: a pair ruled out is no link,
   and it is ruled out inside the list's task, before it becomes a row. Sets of more than about 3,000 n-grams are too large for SKETCH bits.

Defined cases: null text is empty; an empty set links with nothing; rows of one identifier are one node; rows with a null
identifier get a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .frames import partitions, pick, stored
from .text import as_bytes, document_words, mix, shingles

BITS, OCTAVE = 24, 8
PART_TOKENS = 2_000_000
FLUSH = 1 << 19
HOT = 1 << 18
PAIRS = 1 << 18
LONG = 64
BROADCAST_IDS = 1_000_000
HEADS, PROBES = 4, 1
CROWD, SKETCH = 4, 1 << 12


def _sets(batch_column, n: int):
    for lo in range(0, len(batch_column), 256):  # texts that are Python objects at a time
        for w in document_words(as_bytes(batch_column.slice(lo, 256))):
            yield shingles(w, n)


def parities(s: np.ndarray) -> bytes:
    """One bit a bucket: whether an odd number of the set's n-grams falls into it. Half as many buckets are the two halves' sum."""
    m = min(SKETCH, 1 << max(6, (3 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


class Unlike:
    """Which pairs of entries of a block cannot reach the threshold by the parities of their sets; entries without them never."""

    def __init__(self, doc, size, sketch, percent: int):
        self.size, self.percent = size, percent
        _, self.row = np.unique(doc, return_inverse=True)
        self.bits = sketch
        # of each entry: in a crowded list it has parities, in a short one of the same document it has none
        self.words = np.array([len(x) // 8 if x is not None else 0 for x in sketch], np.int64)
        best = np.lexsort((-self.words, self.row))
        self.source = best[np.append(True, self.row[best][1:] != self.row[best][:-1])] if len(doc) else best
        self.folded: dict[int, np.ndarray] = {}

    def _at(self, w: int) -> np.ndarray:
        """The parities of all documents in w words of 64 bits, zero for those with fewer."""
        if w not in self.folded:
            out = np.zeros((len(self.source), w), np.uint64)
            size = self.words[self.source]
            for k in np.unique(size[size >= w]):
                at = np.flatnonzero(size == k)
                x = np.frombuffer(b"".join(self.bits[self.source[i]] for i in at), "<u8").reshape(len(at), k)
                out[at] = np.bitwise_xor.reduce(x.reshape(len(at), k // w, w), axis=1)
            self.folded[w] = out
        return self.folded[w]

    def __call__(self, i, j) -> np.ndarray:
        out = np.zeros(len(i), bool)
        words = np.minimum(self.words[i], self.words[j])
        for w in np.unique(words[words > 0]):
            t, of = self._at(int(w)), np.flatnonzero(words == w)
            for lo in range(0, len(of), 1 << 15):
                x = of[lo : lo + (1 << 15)]
                differ = np.bitwise_count(t[self.row[i[x]]] ^ t[self.row[j[x]]]).sum(axis=1, dtype=np.int64)
                out[x] = (100 + self.percent) * differ > (100 - self.percent) * (self.size[i[x]] + self.size[j[x]])
        return out


def sketches(texts: DataFrame, n: int) -> DataFrame:
    """(of, sketch) of the documents with one text; an identifier of several texts has no parities and is never ruled out."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parities(s) for s in _sets(b.column(1), n)], pa.binary())], ["of", "sketch"])

    t = texts.select("doc", "text").mapInArrow(run, "of long, sketch binary")
    return stored(t.groupBy("of").agg(F.count(F.lit(1)).alias("texts"), F.max("sketch").alias("sketch")).where("texts = 1").drop("texts"), "ngram-parities")


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITS)).astype(np.int64)


def ngram_order(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Weights of 2 ** BITS hash buckets of n-grams, OCTAVE steps per doubling of their number of documents, over all
    documents; and the number of n-grams. The table has a fixed size and one byte per bucket."""
    step = 1 << 18

    def run(batches):
        total, held, size = np.zeros(1 << BITS, np.uint16), [], 0

        def add():
            at, times = np.unique(_bucket(np.concatenate(held)).astype(np.uint32), return_counts=True)
            total[at] = np.minimum(total[at].astype(np.int64) + times, 65535)  # one task's share; tasks are added without a bound

        for b in batches:
            for x in _sets(b.column(0), n):
                held.append(x)
                size += len(x)
                if size >= FLUSH:
                    add()
                    held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(total.reshape(-1, step).any(axis=1))
        blobs = [pa.compress(total[i * step : (i + 1) * step].tobytes(), codec="zstd", asbytes=True) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["at", "counts"])

    def add_up(batches):
        at, total = None, None

        def row():
            weight = np.minimum(255, OCTAVE * np.log2(total + 1.0)).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([weight.tobytes()], pa.binary()), pa.array([int(total.sum())])], ["at", "weights", "n"])

        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1)):
                if i != at:
                    if at is not None:
                        yield row()
                    at, total = i, np.zeros(step, np.int64)
                total += np.frombuffer(pa.decompress(c.as_py(), 2 * step, codec="zstd", asbytes=True), np.uint16)
        if at is not None:
            yield row()

    part = pick(docs, "text").mapInArrow(run, "at int, counts binary")
    summed = part.repartition(max(16, partitions(docs.sparkSession)), "at").sortWithinPartitions("at").mapInArrow(add_up, "at int, weights binary, n long")
    out, count = np.zeros(1 << BITS, np.uint8), 0
    for r in summed.toLocalIterator():  # (1 << BITS) / step rows of fixed size
        out[r["at"] * step : (r["at"] + 1) * step] = np.frombuffer(bytes(r["weights"]), np.uint8)
        count += r["n"]
    return out, count


def needed(percent: int, size):
    """Least overlap of a set with any partner: ceil(t * n)."""
    return -(-percent * size // 100)


def packed(tok, doc, size, pos) -> bytes:
    """The n-grams of one part. 32 bits of each are enough: within a part a false meeting is only one more candidate."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    runs = np.diff(np.append(first, len(doc))).astype("<i4")
    step = np.diff(doc[first], prepend=0).astype("<i8")
    raw = b"".join(x.tobytes() for x in (np.array([len(tok), len(first)], "<i4"), step, size[first].astype("<i4"), runs, pos.astype("<i4"), (tok & np.uint64(0xFFFFFFFF)).astype("<u4")))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes):
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, "<i4", 2)
    step, at = np.frombuffer(raw, "<i8", m, 8), 8 + 8 * m
    size, runs, pos, tok = (np.frombuffer(raw, kind, k, at + off) for kind, k, off in (("<i4", m, 0), ("<i4", m, 4 * m), ("<i4", n, 8 * m), ("<u4", n, 8 * m + 4 * n)))
    return tok, np.repeat(np.cumsum(step), runs), np.repeat(size, runs), pos


def prefixes(docs: DataFrame, n: int, percent: int, hot: int = HOT) -> tuple[DataFrame, int, bool]:
    """Rows of members (doc_id, rep, size) and of packed prefix n-grams (blob), each with the part it goes to and, for n-grams
    of more than about 2 * hot documents, the piece of the part, from 1 on. Also whether all lists are in one piece."""
    spark = docs.sparkSession
    order, count = ngram_order(docs, n)
    parts = max(partitions(spark), count * (100 - percent) // 100 // PART_TOKENS + 1)
    likely = 2.0 ** (np.arange(256) / OCTAVE) - 2 * count / (1 << BITS)  # documents of one n-gram, by weight
    salts = np.clip(likely // hot, 1, 1 << 20).astype(np.int64)
    shared = spark.sparkContext.broadcast((order, salts))  # one byte per bucket

    def run(batches):
        weight, salt = shared.value
        seen: dict[tuple, int] = {}
        held: list[tuple] = []
        count = 0

        def flush():
            tok = np.concatenate([h[0] for h in held])
            lens = [len(h[0]) for h in held]
            doc = np.repeat(np.array([h[1] for h in held], np.int64), lens)
            size = np.repeat(np.array([h[2] for h in held], np.int32), lens)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lens])
            s = salt[weight[_bucket(tok)]]
            place = (((tok >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) << 21) + np.where(s > 1, 1 + doc % s, 0)
            by = np.argsort(place, kind="stable")
            at = np.flatnonzero(np.diff(place[by], prepend=-1))
            rows = place[by[at]]
            at = np.append(at, len(by))
            blobs = [packed(*(c[by[at[p] : at[p + 1]]] for c in (tok, doc, size, pos))) for p in range(len(rows))]
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            where = [pa.array(x, pa.int32()) for x in (rows >> 21, rows & ((1 << 21) - 1))]
            return pa.RecordBatch.from_arrays([none, none, none, *where, pa.array(blobs, pa.binary())], names)

        names = ["doc_id", "rep", "size", "part", "piece", "blob"]
        for b in batches:
            ids, reps, sizes = b.column(0).to_pylist(), [], []
            for i, s in zip(ids, _sets(b.column(1), n)):
                size = len(s)
                sizes.append(size)
                if i is None or not size:
                    reps.append(i)
                    continue
                key = (size, int(s.sum()), int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15))))
                rep = seen.get(key)
                if rep is not None:
                    reps.append(rep)
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen[key] = i
                reps.append(i)
                k = size - needed(percent, size) + 1
                held.append((s[np.lexsort((s, weight[_bucket(s)]))[:k]], i, size))
                count += k
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
            m = len(ids)
            spread = np.arange(m, dtype=np.int32) % parts
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spread), pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary())], names)
        if held:
            yield flush()

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, rep long, size long, part int, piece int, blob binary"), parts, int(salts[order].max()) == 1


def _possible(percent: int, na, pa_, nb, pb):
    """Length and positional filters for a common n-gram at positions pa_ and pb of sets with na <= nb n-grams."""
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (100 * na >= percent * nb) & ((100 + percent) * most >= percent * (na + nb))


def postings(table: DataFrame, parts: int, percent: int) -> DataFrame:
    """One stored table of three kinds of rows: entries (token, doc, size, pos) of lists with several documents, star pairs
    (a, b, size) of a member a and the head b of size many of its lists, and the members as they came."""
    names = ["token", "doc", "size", "pos", "a", "b", "rep"]

    def rows(m: int, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.int64()) if c in cols else pa.nulls(m, pa.int64()) for c in names], names)

    def lists(blobs, whole):
        tok, doc, size, pos = (np.concatenate(c) for c in zip(*map(unpacked, blobs)))
        by = np.lexsort((doc, size, tok))
        tok, doc, size, pos = tok[by], doc[by], size[by], pos[by]
        same = np.zeros(len(tok), bool)
        same[1:] = (tok[1:] == tok[:-1]) & (doc[1:] == doc[:-1])
        tok, doc, size, pos = tok[~same], doc[~same], size[~same], pos[~same]
        new = np.ones(len(tok), bool)
        new[1:] = tok[1:] != tok[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(tok)))
        keep = np.repeat((length > 1) | (not whole), length)  # alone in its piece is not alone in its list
        return tok[keep], doc[keep], size[keep].astype(np.int64), pos[keep].astype(np.int64)

    def emit(tok, doc, size, pos):
        for lo in range(0, len(tok), 50_000):
            x = slice(lo, lo + 50_000)
            yield rows(len(tok[x]), token=tok[x].astype(np.int64), doc=doc[x], size=size[x], pos=pos[x])
        rest = np.arange(len(tok))
        pairs = []
        while len(rest):
            t = tok[rest]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            length = np.diff(np.append(start, len(rest)))
            # any member may be the head; a different one in each list gives a document several heads
            pick_ = start + (mix(t[start].astype(np.uint64) + np.uint64(len(rest))) % length.astype(np.uint64)).astype(np.int64)
            head = rest[np.repeat(pick_, length)]
            near = 100 * np.minimum(size[head], size[rest]) >= percent * np.maximum(size[head], size[rest])
            x, y = np.where(size[head] <= size[rest], head, rest), np.where(size[head] <= size[rest], rest, head)
            ok = near & (head != rest) & _possible(percent, size[x], pos[x], size[y], pos[y])
            pairs.append(np.stack([doc[rest[ok]], doc[head[ok]]], axis=1))
            rest = rest[~near]
        p, times = np.unique(np.concatenate(pairs), axis=0, return_counts=True) if pairs else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        for lo in range(0, len(p), 50_000):
            x = p[lo : lo + 50_000]
            yield rows(len(x), a=x[:, 0], b=x[:, 1], size=times[lo : lo + 50_000])

    def run(batches):
        now, blobs = None, []
        for b in batches:
            member = b.filter(pa.compute.is_null(b.column(5)))
            if member.num_rows:
                yield rows(member.num_rows, doc=member.column(0), rep=member.column(1), size=member.column(2))
            b = b.filter(pa.compute.is_valid(b.column(5)))
            for *p, x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5))):
                if p != now and blobs:
                    for out in emit(*lists(blobs, now[1] == 0)):
                        yield out.set_column(0, "token", with_part(out.column(0), now[0]))
                    blobs = []
                now = p
                blobs.append(x)
        if blobs:
            for out in emit(*lists(blobs, now[1] == 0)):
                yield out.set_column(0, "token", with_part(out.column(0), now[0]))

    def with_part(column, part):
        """An n-gram's number is unique with its part only."""
        return column if column.null_count else pa.array(np.asarray(column) | (np.int64(part) << 32))

    t = table.repartition(parts, "part", "piece").sortWithinPartitions("part", "piece")
    return stored(t.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "ngram-postings")


def nearest_heads(pairs: DataFrame) -> DataFrame:
    """Of each document's heads the HEADS that it shares most lists with, as distinct pairs (a, b) with a < b."""
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("times"), F.xxhash64("b"), "b"))
    p = pairs.groupBy("a", "b").agg(F.sum("times").alias("times")).withColumn("r", best).where(F.col("r") <= HEADS)
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crowded(e: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The tokens of more than ``hot`` entries; and for those of several components (token, slices, blocks, common, head): the
    numbers of cells for all members and for those outside the most frequent component, that component and one member."""
    n = F.count(F.lit(1))
    long = stored(e.groupBy("token").agg(n.alias("n"), (F.min("label") != F.max("label")).alias("mixed")).where(F.col("n") > hot), "ngram-hot")
    kinds = e.join(F.broadcast(long.where("mixed")), "token").groupBy("token", "n", "label")
    kinds = kinds.agg(n.alias("times"), F.min(F.struct(F.xxhash64("token", "doc").alias("r"), "doc", "size", "pos")).alias("head"))
    best = kinds.groupBy("token", "n").agg(F.max(F.struct("times", "label", "head")).alias("m"))
    cells = [F.ceil(c / F.lit(hot)).cast("int") for c in (F.col("n"), F.col("n") - F.col("m.times"))]
    crowd = best.select("token", cells[0].alias("slices"), cells[1].alias("blocks"), F.col("m.label").alias("common"), F.col("m.head").alias("head"))
    return F.broadcast(long.select("token")), F.broadcast(stored(crowd, "ngram-crowded"))  # each stands for more than ``hot`` entries


def cross_pairs(entries: DataFrame, labels: DataFrame, percent: int, probe: bool = False, hot: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Distinct possible pairs (a, b) of list members that lie in different components.

    ``probe`` gives (a, b, times) instead: each member outside the most frequent component of a list with one member of that
    component, which is another in every list. Lists of more than ``hot`` entries are not gathered in one task: each member
    lies in one slice, each member outside the most frequent component also visits every slice, and only visitors meet members.
    ``known`` holds the documents' parities, which travel with the members of crowded lists.
    """
    n = partitions(entries.sparkSession)
    e = entries.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "size", "pos", F.coalesce("comp", "doc").alias("label"))
    crowd = None
    if hot is not None:
        e = stored(e, "ngram-labelled")
        long, crowd = crowded(e, hot)
        hot_e = e.join(crowd, "token")
        e = e.join(long, "token", "left_anti")
    mixed = e.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo <> hi").select("token", "many")
    e = e.join(mixed, "token")
    if known is not None and not probe:
        e = e.join(known, (F.col("doc") == F.col("of")) & (F.col("many") > CROWD), "left")
    else:
        e = e.withColumn("sketch", F.lit(None).cast("binary"))
    e = e.select("token", "doc", "size", "pos", "label", "sketch").repartition(n, "token").sortWithinPartitions("token", "size", "doc")

    def lists(batches):
        """Whole lists as column tuples, gathered to blocks of several lists."""
        held = []
        for b in batches:
            x = [np.array(c.to_pylist() + [None], object)[:-1] if pa.types.is_binary(c.type) else np.asarray(c) for c in b.columns]
            last = x[0][-1] if len(x[0]) else None
            cut = int(np.flatnonzero(x[0] != last)[-1]) + 1 if len(x[0]) and x[0][0] != last else 0
            if cut:
                yield [np.concatenate([*(h[k] for h in held), c[:cut]]) for k, c in enumerate(x)]
                held = []
            if len(x[0]):
                if held and held[-1][0][-1] != last:
                    yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]
                    held = []
                held.append([c[cut:] for c in x])
        if held:
            yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]

    def meeting(i, j, doc, size, pos):
        """Columns (a, b, size of a, size of b, times, place in a, place in b) of members i and j of a list, a < b."""
        swap = doc[i] > doc[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return np.stack([doc[i], doc[j], size[i], size[j], np.ones(len(i), np.int64), pos[i], pos[j]], axis=1)

    def added(rows):
        """One row per pair: how many n-grams met, and where the last of them lies in both."""
        r = np.concatenate(rows)
        r = r[np.lexsort((r[:, 3], r[:, 2], r[:, 1], r[:, 0]))]
        start = np.flatnonzero(np.append(True, (r[1:, :4] != r[:-1, :4]).any(axis=1)))
        return np.concatenate([r[start, :4], np.add.reduceat(r[:, 4:5], start), np.maximum.reduceat(r[:, 5:], start)], axis=1)

    def short_lists(doc, size, pos, label, ends, unlike):
        """Pairs at growing distance in all lists at once; an entry leaves where its list ends or sizes grow too far apart."""
        live, step = np.arange(len(doc)), 1
        while True:
            live = live[live + step < ends[live]]
            live = live[100 * size[live] >= percent * size[live + step]]
            if not len(live):
                return
            other = live + step
            ok = (label[live] != label[other]) & _possible(percent, size[live], pos[live], size[other], pos[other])
            i, j = live[ok], other[ok]
            ok = ~unlike(i, j)
            yield meeting(i[ok], j[ok], doc, size, pos)
            step += 1

    def long_list(doc, size, pos, label, unlike):
        """All members outside the most frequent component against the whole list."""
        kinds, times = np.unique(label, return_counts=True)
        for i in np.flatnonzero(label != kinds[times.argmax()]):
            lo = np.searchsorted(size, -(-percent * size[i] // 100))
            hi = np.searchsorted(size, 100 * size[i] // percent, side="right")
            j = np.arange(lo, hi)
            small, large = np.minimum(i, j), np.maximum(i, j)
            ok = (label[j] != label[i]) & _possible(percent, size[small], pos[small], size[large], pos[large])
            j = j[ok]
            j = j[~unlike(np.full(len(j), i), j)]
            yield meeting(np.full(len(j), i), j, doc, size, pos)

    def probes(batches):
        for tok, doc, size, pos, label in lists(batches):
            by = np.lexsort((label, tok))
            t, k = tok[by], label[by]
            group = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            count = np.diff(np.append(group, len(t)))
            best = np.lexsort((-count, t[group]))
            best = best[np.append(True, t[group][best][1:] != t[group][best][:-1])]  # the largest component of each list
            at = group[best] + (mix(t[group[best]].astype(np.uint64)) % count[best].astype(np.uint64)).astype(np.int64)
            where = np.searchsorted(t[group[best]], tok)
            head = by[at][where]
            x, y = np.where(size[head] <= size, head, np.arange(len(tok))), np.where(size[head] <= size, np.arange(len(tok)), head)
            ok = (label != label[head]) & _possible(percent, size[x], pos[x], size[y], pos[y])
            p, times = np.unique(np.stack([doc[ok], doc[head[ok]]], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(times)], ["a", "b", "times"])

    def found(batches):
        for tok, doc, size, pos, label, sketch in lists(batches):
            start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            length = np.diff(np.append(start, len(tok)))
            short = np.repeat(length <= LONG, length)
            count = np.repeat(length, length)[short]
            first = np.flatnonzero(np.append(True, tok[short][1:] != tok[short][:-1])) if short.any() else np.zeros(0, np.int64)
            ends = np.repeat(np.append(first[1:], int(short.sum())), np.diff(np.append(first, int(short.sum())))) if len(count) else count
            cols = [c[short] for c in (doc, size, pos, label)]
            yield from short_lists(*cols, ends, Unlike(*cols[:2], sketch[short], percent))
            for s, m in zip(start[length > LONG], length[length > LONG]):
                at = slice(s, s + m)
                yield from long_list(doc[at], size[at], pos[at], label[at], Unlike(doc[at], size[at], sketch[at], percent))

    def visits(batches):
        """Cells: guest is 2 for visitors, 1 for other members outside the most frequent component, else 0."""
        for cell, doc, size, pos, label, guest in lists(batches):
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for s, m in zip(start, np.diff(np.append(start, len(cell)))):
                at = np.arange(s, s + m)
                own = at[guest[at] < 2]
                for i in at[guest[at] == 2]:
                    lo = np.searchsorted(size[own], -(-percent * size[i] // 100))
                    hi = np.searchsorted(size[own], 100 * size[i] // percent, side="right")
                    j = own[lo:hi]
                    small, large = np.where(size[j] < size[i], j, i), np.where(size[j] < size[i], i, j)
                    ok = (label[j] != label[i]) & ((guest[j] == 0) | (doc[i] < doc[j])) & _possible(percent, size[small], pos[small], size[large], pos[large])
                    yield meeting(np.full(int(ok.sum()), i), j[ok], doc, size, pos)

    names = ["a", "b", "na", "nb", "times", "i", "j"]

    def run(batches, source=found):
        held, n_held = [], 0
        out = lambda u: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, k])) for k in range(7)], names)
        for p in source(batches):
            held.append(p)
            n_held += len(p)
            if n_held > PAIRS:
                u = added(held)
                held, n_held = [u], len(u)
                if n_held > PAIRS // 2:
                    yield out(u)
                    held, n_held = [], 0
        if n_held:
            yield out(added(held))

    if probe:
        p = e.select("token", "doc", "size", "pos", "label").mapInArrow(probes, "a long, b long, times long")
        if crowd is not None:
            sizes, places = (F.col("size"), F.col("head.size")), (F.col("pos"), F.col("head.pos"))
            most = F.least(*places) + F.least(*(x - y for x, y in zip(sizes, places)))
            near = (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & ((100 + percent) * most >= percent * (sizes[0] + sizes[1]))
            p = p.unionByName(hot_e.where((F.col("label") != F.col("common")) & near).select(F.col("doc").alias("a"), F.col("head.doc").alias("b"), F.lit(1).cast("long").alias("times")))
        return nearest_heads(p)
    kinds = ", ".join(f"{c} long" for c in names)
    met = e.mapInArrow(run, kinds)
    if crowd is not None:
        away = F.col("label") != F.col("common")
        own, block = F.pmod(F.xxhash64("doc"), F.col("slices")), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks"))
        member = hot_e.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).withColumn("cell", own * F.col("blocks") + F.col("k"))
        visitor = hot_e.where(away).select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("k")).withColumn("cell", F.col("k") * F.col("blocks") + block)
        cells = member.withColumn("guest", away.cast("long")).unionByName(visitor.withColumn("guest", F.lit(2).cast("long")))
        cells = cells.select(F.xxhash64("token", "cell").alias("cell"), "doc", "size", "pos", "label", "guest")
        cells = cells.repartition(n, "cell").sortWithinPartitions("cell", "size", "doc")
        met = met.unionByName(cells.mapInArrow(lambda b: run(b, visits), kinds))
    met = met.groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    # all common n-grams up to the last common one of both prefixes have met; the rest of the shorter remainder may follow
    reach = (100 + percent) * (F.col("c") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1) >= percent * (F.col("na") + F.col("nb"))
    return met.where(reach).select("a", "b").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    total = len(x) + len(y)
    least = -(-percent * total // (100 + percent))
    if min(len(x), len(y)) < least:
        return False
    if len(y) > 64:  # suffix filter: n-grams between common pivots that have no partner
        pivot = y[np.arange(1, 8) * len(y) // 8]
        gaps = np.diff(np.concatenate([[0], np.searchsorted(x, pivot), [len(x)]])) - np.diff(np.concatenate([[0], np.arange(1, 8) * len(y) // 8, [len(y)]]))
        if np.abs(gaps).sum() > total - 2 * least:
            return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) >= least


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                ok = [linked(x, y, percent) for x, y in zip(_sets(s.column(2), n), _sets(s.column(3), n))]
                yield s.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    j = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    j = j.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return j.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text) of the documents that occur in any posting list with several members."""
    wanted = stored(wanted, "ngram-wanted")
    if wanted.count() <= BROADCAST_IDS:  # eight bytes each
        wanted = F.broadcast(wanted)
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return stored(d.join(wanted, "doc", "left_semi"), "ngram-texts")


def components(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return stored(connected_components(nodes, links, keys=()), "ngram-components")


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    table, parts, whole_lists = prefixes(docs, n, percent, hot)
    lists = postings(table, parts, percent)
    pair = F.col("a").isNotNull()
    members = lists.where(~pair & F.col("token").isNull()).select(F.col("doc").alias("doc_id"), "rep", "size")
    entries = lists.where("token is not null").select("token", "doc", "size", "pos")
    tried = stored(nearest_heads(lists.where(pair).select("a", "b", F.col("size").alias("times"))), "ngram-stars")
    texts = candidate_texts(docs, entries.select("doc").distinct())
    copies = members.where("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()
    links = stored(verify(tried, texts, n, percent).unionByName(copies), "ngram-links")
    labels = components(links)
    for probe in (*[True] * PROBES, False):  # the last round leaves no pair between components unseen
        known = None if probe else sketches(texts, n)
        more = stored(cross_pairs(entries, labels, percent, probe, None if whole_lists else hot, known).join(tried, ["a", "b"], "left_anti"), "ngram-cross")
        if more.limit(1).count():
            links = links.unionByName(stored(verify(more, texts, n, percent), "ngram-links"))
            labels = components(links)
            tried = tried.unionByName(more)
    low = labels.select(F.col("node").alias("doc_id"), "comp")
    return members.join(low, "doc_id", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
