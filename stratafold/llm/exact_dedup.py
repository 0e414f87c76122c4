"""Exact deduplication with Patricia tries.

Texts are equal when identical after each run of white space becomes one space (null counts as empty). Every map task
first joins its own equal texts, so a text that a third of all rows share leaves a task once. The distinct texts are then
dealt by (length, content hash); each task inserts the full byte strings into a compressed radix trie whose terminal
nodes hold the smallest identifier, the number of rows and the local groups that ended there. Above a memory limit the
heaviest subtree goes to a temporary file of the task and is finished on its own, again by subtrees if need be.

Defined cases: rows with a null identifier belong to their group but stay only if the whole group has none; of rows that
repeat both identifier and text exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, pick, stored, text_or_empty

SPACE = "[\\x20\\x09-\\x0D]+"
LOCAL_BYTES = 24 << 20
TRIE_BYTES = 96 << 20


def common(a: bytes, i: int, b: bytes) -> int:
    """Length of the common prefix of a[i:] and b."""
    n = min(len(a) - i, len(b))
    if a[i : i + n] == b[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:  # the first mismatch is at or before hi
        mid = (lo + hi) // 2 + 1
        if a[i + lo : i + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed radix trie over byte strings; ``add`` merges a payload into the terminal node of its string."""

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.merge, self.limit, self.bytes = merge, limit, 0
        self.root = [b"", {}, None]  # label, children by first byte, payload
        self.files: dict[bytes, object] = {}

    def add(self, key: bytes, payload) -> None:
        for prefix, f in self.files.items():
            if key.startswith(prefix):
                pickle.dump((key, payload), f)
                return
        node, i = self.root, 0
        while i < len(key):
            child = node[1].get(key[i])
            if child is None:
                node[1][key[i]] = [key[i:], {}, payload]
                self.bytes += len(key) - i + 200
                break
            label = child[0]
            n = common(key, i, label)
            if n < len(label):  # split the edge
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][key[i]] = upper
                child = upper
                self.bytes += 200
            node, i = child, i + n
        else:
            node[2] = payload if node[2] is None else self.merge(node[2], payload)
        if self.bytes > self.limit:
            self._spill()

    def _walk(self, node, prefix: bytes):
        stack = [(node, prefix)]
        while stack:
            x, p = stack.pop()
            if x[2] is not None:
                yield p, x[2]
            stack += [(c, p + c[0]) for c in x[1].values()]

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while len(node[1]) == 1 and (node is self.root or node[2] is None):
            (child,) = node[1].values()
            if not child[1]:
                break
            node, prefix = child, prefix + child[0]
        if len(node[1]) < 2:
            self.limit = max(self.limit, 2 * self.bytes)  # one single string: there is nothing to part
            return

        def weight(n) -> int:
            total, stack = 0, [n]
            while stack:
                x = stack.pop()
                total += len(x[0]) + 200
                stack += x[1].values()
            return total

        heavy = max(node[1], key=lambda b: weight(node[1][b]))
        child = node[1].pop(heavy)
        self.bytes -= weight(child)
        f = self.files[prefix + bytes([heavy])] = tempfile.TemporaryFile()
        for item in self._walk(child, prefix + child[0]):
            pickle.dump(item, f)

    def items(self):
        yield from self._walk(self.root, b"")
        self.root = [b"", {}, None]
        for f in self.files.values():
            f.seek(0)
            sub = Trie(self.merge, self.limit)
            while True:
                try:
                    key, payload = pickle.load(f)
                except EOFError:
                    break
                sub.add(key, payload)
            f.close()
            yield from sub.items()


def _smaller(a: tuple, b: tuple) -> bool:
    """Order of (identifier or None, row number): nulls last."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def local_groups(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, rid, first) and one per distinct text of a task (rid, n, h, text, low, rows)."""

    def run(batches):
        task = TaskContext.get()
        base, made = (task.partitionId() if task else 0) << 36, 0
        groups: dict[bytes, list] = {}
        held = 0

        def flush():
            doc, first, rid, text, low, rows, n, h = [], [], [], [], [], [], [], []
            for key, (r, ids, size, hashed) in groups.items():
                best = min((i for i in ids if i is not None), default=None)
                at = ids.index(best)
                doc += ids
                first += [k == at for k in range(len(ids))]
                rid += [r] * len(ids)
                m = len(ids)
                for col in (text, low, rows, n, h):
                    col += [None] * m
                for col, v in ((doc, None), (first, None), (rid, r), (text, key), (low, best), (rows, m), (n, size), (h, hashed)):
                    col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "first", "rid", "text", "low", "rows", "n", "h"]
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, first, rid, text, low, rows, n, h), kinds)], names)

        for b in batches:
            for i, t, n, h in zip(*(c.to_pylist() for c in b.columns)):
                g = groups.get(t)
                if g is None:
                    g = groups[t] = [base + made, [], n, h]
                    made += 1
                    held += n + 300
                g[1].append(i)
                held += 40
                if held > LOCAL_BYTES:
                    yield flush()
                    held = 0
        if groups:
            yield flush()

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.regexp_replace(text_or_empty(), SPACE, " ").alias("t"))
    d = d.select("doc_id", F.encode("t", "utf-8").alias("t"), F.octet_length("t").cast("long").alias("n"), F.xxhash64("t").alias("h"))
    return d.mapInArrow(run, "doc_id long, first boolean, rid long, text binary, low long, rows long, n long, h long")


def trie_owners(groups: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """(rid, keep_id, keep_rid, group_size, text_sha256) for each local group."""

    def merge(a, b):
        low = a[0] if _smaller(a[0], b[0]) else b[0]
        return low, a[1] + b[1], a[2] + b[2]

    def run(batches):
        trie = Trie(merge, limit)
        for b in batches:
            for rid, text, low, rows in zip(*(c.to_pylist() for c in b.columns)):
                trie.add(b"\x00" + text, ((low, rid), rows, [rid]))
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              ["rid", "keep_id", "keep_rid", "group_size", "text_sha256"])

        for key, ((low, first), rows, rids) in trie.items():
            digest = hashlib.sha256(key[1:]).hexdigest()
            out += [(r, low, first, rows, digest) for r in rids]
            if len(out) >= 20_000:
                yield batch()
                out.clear()
        yield batch()

    n = partitions(groups.sparkSession)
    dealt = groups.repartition(n, "n", "h").select("rid", "text", "low", "rows")
    return dealt.mapInArrow(run, "rid long, keep_id long, keep_rid long, group_size long, text_sha256 string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    both = stored(local_groups(docs), "exact-groups")
    members = both.where("text is null").select("doc_id", "first", "rid")
    owners = trie_owners(both.where("text is not null").select("rid", "n", "h", "text", "low", "rows"))
    return members.join(owners, "rid").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256")
