"""Removal of every byte covered by a string of ``LENGTH`` bytes that starts more than once, by a sampled suffix sort.

The difference-cover scheme sorts a sample of all suffixes and derives the order of the others from it. Its fixed residues
would move several rows per byte of text, so the cover here is chosen by content: the position of the smallest hash of the
``GRAM``-byte strings of each window of ``LENGTH`` bytes. Every window holds a sampled position, and equal windows hold it
at the same place, so two equal windows always are windows of equal samples.

1. The hashes of the sampled grams are dealt by hash; grams that occur once are dropped with all their windows.
2. Each remaining sample takes its context along: the bytes of all windows that it was chosen for. Equal contexts of one
   task are sent once, and their windows are known to be repeated, so a passage of a third of all rows leaves a task once.
3. A task sorts the sampled suffixes of its grams: triples of eight-byte words are sorted and named, the names form
   triples again, until one name per suffix remains. The other suffixes are merged from right to left: the one that begins
   a byte earlier is ordered by that byte and the rank of its follower.
4. At every distance adjacent suffixes are compared over ``LENGTH`` bytes (by a 64-bit polynomial hash of the window).
   The windows that found an equal neighbour give one covered interval per sample, since all contain the sample.
5. The intervals of a document are united and cut out of its bytes.

Defined cases: null text is empty; texts shorter than ``LENGTH`` lose nothing; rows that repeat identifier and text are
documents of their own and repeat each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick, text_or_empty
from .text import _BYTE, _power_tables, as_bytes, mix

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams per window
SLICE = 1 << 20
NONE = -(1 << 63)
FLUSH_ROWS, FLUSH_BYTES = 1 << 17, 8 << 20
ROWS = 256  # texts that are Python objects at a time
PARTS = 3  # groups of grams for each shuffle partition: a task sorts the contexts of one group at a time


def _slices(batches):
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power_tables(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def _window_hashes(sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return mix((sums[start + length] - sums[start]) * _power_tables(len(sums))[1][start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def samples(buf: np.ndarray):
    """(gram hash, sampled position, first and last window start) of every sample of a text."""
    parts = []
    low = np.uint64(SLICE * 2 - 1)
    for at in range(0, len(buf) - LENGTH + 1, SLICE):
        part = buf[at : at + SLICE + LENGTH - 1]
        h = _window_hashes(_prefix_sums(part), np.arange(len(part) - GRAM + 1), GRAM)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), SPAN)
        q = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        last = np.append(first[1:], len(q)) - 1
        q = q[first]
        parts.append((h[q], q + at, first + at, last + at))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(c) for c in zip(*parts))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def sampled(docs: DataFrame, parts: int) -> DataFrame:
    """(part, blob): packed gram hashes with the document and position of each."""

    def run(batches):
        held, n = [], 0

        def flush():
            h, d, k, q = (np.concatenate(c) for c in zip(*held))
            part = _part_of(h, parts)
            by = np.argsort(part, kind="stable")
            at = np.searchsorted(part[by], np.arange(parts + 1))
            rows = np.flatnonzero(np.diff(at))
            blobs = []
            for p in rows:
                i = by[at[p] : at[p + 1]]
                m = np.array([len(i)], "<i8")
                blobs.append(_squeeze(m, np.diff(d[i], prepend=0).astype("<i8"), h[i].astype("<u8"), k[i].astype("<i8"), q[i].astype("<i4")))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for b in _slices(batches):
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                if len(t) < LENGTH:
                    continue
                h, q, _, _ = samples(np.frombuffer(t, np.uint8))
                held.append((h, np.full(len(h), d, np.int64), np.full(len(h), k, np.int64), q))
                n += len(h)
                if n >= FLUSH_ROWS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "part int, blob binary")


def _by_part(batches, column: int = 0):
    """(part, blobs) of consecutive rows of one part."""
    now, held = None, []
    for b in batches:
        for p, x in zip(b.column(column).to_pylist(), b.column(column + 1).to_pylist()):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(x)
    if held:
        yield now, held


def shared_samples(packed: DataFrame, parts: int) -> DataFrame:
    """(d, k, at): positions of each document whose gram occurs more than once."""

    def read(blob):
        raw = _expand(blob)
        m = int(np.frombuffer(raw, "<i8", 1)[0])
        return (np.cumsum(np.frombuffer(raw, "<i8", m, 8)), np.frombuffer(raw, "<u8", m, 8 + 8 * m), np.frombuffer(raw, "<i8", m, 8 + 16 * m),
                np.frombuffer(raw, "<i4", m, 8 + 24 * m))

    def run(batches):
        for _, blobs in _by_part(batches):
            d, h, k, q = (np.concatenate(c) for c in zip(*map(read, blobs)))
            by = np.argsort(h, kind="stable")
            same = h[by][1:] == h[by][:-1]
            often = by[np.append(False, same) | np.append(same, False)]
            if not len(often):
                continue
            often = often[np.lexsort((q[often], k[often], d[often]))]
            d, k, q = d[often], k[often], q[often]
            first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), pa.array(q, pa.int32()))
            whole = pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(k[first], pa.int64()), lists], ["d", "k", "at"])
            for lo in range(0, whole.num_rows, 20_000):
                yield whole.slice(lo, 20_000)

    rows = packed.repartition(parts, "part").sortWithinPartitions("part")
    found = rows.mapInArrow(run, "d long, k long, at array<int>")
    # rows that repeat identifier and text send the same places; each is kept once, so n such rows stay n rows of one list
    return found.groupBy("d", "k").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


NAMES = ["d", "k", "lo", "hi", "part", "blob"]
KINDS = "d long, k long, lo long, hi long, part int, blob binary"


def _intervals(rows: list[tuple]):
    cols = list(zip(*rows)) or [()] * 4
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                                       pa.array(np.arange(n) % 997, pa.int32()), pa.nulls(n, pa.binary())], NAMES)


def contexts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with a blob: packed contexts of a part. Rows without: intervals (d, k, lo, hi) that a task already knows."""

    def run(batches):
        seen: dict[tuple[bytes, int], list] = {}
        size = 0

        def flush():
            known, by_part = [], {}
            for (text, before), (part, occ, n) in seen.items():
                if n > 1:
                    known += occ
                by_part.setdefault(part, []).append((text, before, occ[0] if n == 1 else (0, 0, -1, 0)))
            rows, blobs = list(by_part), []
            for p in rows:
                c = by_part[p]
                head = np.array([(len(t), before, o[0], o[1], o[2]) for t, before, o in c], "<i8")
                blobs.append(_squeeze(np.array([len(c)], "<i8"), head, np.frombuffer(b"".join(t for t, _, _ in c), np.uint8)))
            seen.clear()
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], NAMES)
            if known:
                yield _intervals(known)

        for b in _slices(batches):
            for d, k, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3)):
                h, q, first, last = samples(np.frombuffer(t, np.uint8))
                keep = np.isin(q, np.asarray(at.values))
                part = _part_of(h[keep], parts)
                for p, x, lo, hi in zip(part.tolist(), q[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                    text = t[lo : hi + LENGTH]
                    s = seen.get((text, x - lo))
                    if s is None:
                        seen[text, x - lo] = [p, [(d, k, lo, hi + LENGTH)], 1]
                        size += len(text) + 400
                    else:
                        s[1].append((d, k, lo, hi + LENGTH))
                        s[2] += 1
                        size += 150
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if seen:
            yield from flush()

    return docs.mapInArrow(run, KINDS)


def suffix_ranks(right: np.ndarray) -> np.ndarray:
    """Order-preserving names of rows of 27 big-endian eight-byte words: triples are sorted and named until one name is left."""
    names = right
    while names.shape[1] > 1:
        m = names.shape[1] // 3
        triples = names.reshape(-1, 3)
        by = np.lexsort((triples[:, 2], triples[:, 1], triples[:, 0]))
        s = triples[by]
        new = np.append(False, (s[1:] != s[:-1]).any(axis=1)) if len(s) else np.zeros(0, bool)
        rank = np.empty(len(s), np.uint64)
        rank[by] = np.cumsum(new)
        names = rank.reshape(-1, m)
    return names[:, 0].astype(np.int64)


def repeated_windows(text: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray):
    """For contexts text[start : start + size] with the sample ``before`` bytes after their start: the least and largest
    distance to the sample at which a window is repeated, -1 if none is."""
    n = len(start)
    sample = start + before
    words = np.zeros((n, 27 * 8), np.uint8)
    right = size - before
    for j in range(LENGTH):
        in_reach = j < right
        words[in_reach, j] = text[sample[in_reach] + j]
    rank = suffix_ranks(words.view(">u8").astype(np.uint64))
    sums = _prefix_sums(text)
    least, most = np.full(n, -1), np.full(n, -1)
    nearest = np.maximum(0, LENGTH - right)  # windows end inside the context
    live = np.arange(n)
    for o in range(int(before.max()) + 1 if n else 0):
        live = live[before[live] >= o]
        if o:
            char = text[sample[live] - o].astype(np.int64)
            key = char * (n + 1) + rank[live]
            by = np.argsort(key, kind="stable")
            s = key[by]
            fresh = np.empty(len(live), np.int64)
            fresh[by] = np.cumsum(np.append(0, s[1:] != s[:-1]))
            rank[live] = fresh
            order = live[by]
        else:
            order = live[np.argsort(rank[live], kind="stable")]
        order = order[nearest[order] <= o]
        if len(order) < 2:
            continue
        w = _window_hashes(sums, sample[order] - o, LENGTH)
        same = w[1:] == w[:-1]
        hit = order[np.append(False, same) | np.append(same, False)]
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


def covered(rows: DataFrame, parts: int) -> DataFrame:
    """(d, k, lo, hi): byte ranges of documents that lie in repeated strings."""

    def solve(blobs):
        heads, texts = [], []
        for x in blobs:
            raw = _expand(x)
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            heads.append(np.frombuffer(raw, "<i8", 5 * m, 8).reshape(m, 5))
            texts.append(np.frombuffer(raw, np.uint8, offset=8 + 40 * m))
        head, text = np.concatenate(heads), np.concatenate(texts)
        start = np.cumsum(head[:, 0]) - head[:, 0]
        least, most = repeated_windows(text, start, head[:, 0], head[:, 1])
        found = np.flatnonzero((most >= 0) & (head[:, 4] >= 0))
        x = head[found, 4] + head[found, 1]
        return pa.RecordBatch.from_arrays([pa.array(head[found, 2]), pa.array(head[found, 3]), pa.array(x - most[found]),
                                           pa.array(x + LENGTH - least[found])], ["d", "k", "lo", "hi"])

    def run(batches):
        def packed():
            for b in batches:
                ready = pa.compute.is_null(b.column(5))
                known = b.filter(ready)
                if known.num_rows:
                    yield None, known.select(["d", "k", "lo", "hi"])
                rest = b.filter(pa.compute.invert(ready))
                if rest.num_rows:
                    yield rest, None

        now, held = None, []
        for rest, known in packed():
            if known is not None:
                yield known
                continue
            for p, x in zip(rest.column(4).to_pylist(), rest.column(5).to_pylist()):
                if p != now and held:
                    yield solve(held)
                    held = []
                now = p
                held.append(x)
        if held:
            yield solve(held)

    dealt = rows.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "d long, k long, lo long, hi long")


def cut_out(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) from documents with their ``ranges``."""

    def run(batches):
        for s in _slices(batches):
            size, gone, spans, kept = [], [], [], []
            for t, r in zip(as_bytes(s.column(1)), s.column(2)):
                size.append(len(t))
                if not r.is_valid:
                    gone.append(0)
                    spans.append(0)
                    kept.append(t)
                    continue
                a = np.asarray(r.values.field(0))
                z = np.asarray(r.values.field(1))
                mark = np.bincount(a, minlength=len(t) + 1) - np.bincount(z, minlength=len(t) + 1)
                out = np.cumsum(mark)[: len(t)] > 0
                gone.append(int(out.sum()))
                spans.append(int((np.diff(out.view(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~out].tobytes())
            cols = [s.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document with the bytes that remain."""
    parts = PARTS * partitions(docs.sparkSession)
    d = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), F.xxhash64("text").alias("k"), text_or_empty().alias("text"))
    shared = shared_samples(sampled(d.select("d", "k", "text"), parts), parts)
    found = contexts(d.join(shared, ["d", "k"]).select("d", "k", "text", "at"), parts)
    ranges = covered(found, parts).groupBy("d", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    out = d.join(ranges, ["d", "k"], "left").select(F.when(F.col("d") != NONE, F.col("d")).alias("doc_id"), "text", "ranges")
    return cut_out(out)


def digest(docs: DataFrame) -> DataFrame:
    r = remove_repeats(docs)
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
