"""Byte-pair encoding and decoding with the merge list of a public vocabulary file.

Each pre-token is a doubly linked list of symbols. A priority queue holds (merge rank, position) of every adjacent pair
that has a merge; an entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates the byte
strings of the ids. Null text counts as empty; empty text gives no ids.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_PAIRS = [" " + c for c in " \t\n\v\f\r\x1c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
REMEMBERED = 120_000  # results a worker keeps per generation; dropped ones are only computed again


class Memory(dict):
    """Remembers results of a pure function in two generations, so its size stays bounded."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_characters() -> list[str]:
    """Printable stand-in of each byte: itself if visible Latin-1, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [to[b] for b in range(256)]


class Tokenizer:
    """Vocabulary, merges and added tokens of one file; small enough to travel with a task."""

    def __init__(self, spec: str):
        self.spec = spec
        self._load()

    def __reduce__(self):
        return Tokenizer, (self.spec,)

    def _load(self) -> None:
        j = json.loads(self.spec)
        vocab, shown = j["model"]["vocab"], byte_characters()
        back = {c: b for b, c in enumerate(shown)}
        self.first = [vocab[c] for c in shown]
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        none: dict[int, int] = {}
        self.ranks, self.made = [none] * (max(vocab.values()) + 1), []
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if self.ranks[vocab[a]] is none:
                self.ranks[vocab[a]] = {}
            self.ranks[vocab[a]].setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        self.byte_pairs = [[self.ranks[a].get(b, -1) for b in self.first] for a in self.first]
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.word_ids, self.chunk_ids = Memory(self._word), Memory(self._chunk)

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def merge(self, word: bytes) -> list[int]:
        first, pairs, made = self.first, self.byte_pairs, self.made
        sym = [first[b] for b in word]
        rank = [pairs[a][b] for a, b in zip(word, word[1:])]  # of the pair that begins here; -1: none
        rank.append(-1)
        n = len(sym)
        bits = n.bit_length()
        queue = [r << bits | i for i, r in enumerate(rank) if r >= 0]
        if not queue:
            return sym
        nxt, prv, ranks, low = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks, (1 << bits) - 1
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, r = top & low, top >> bits
            if rank[i] != r:
                continue  # stale: one of the two symbols has been merged since
            j = nxt[i]
            new = sym[i] = made[r]
            sym[j] = rank[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                r = rank[i] = ranks[new].get(sym[k], -1)
                if r >= 0:
                    heappush(queue, r << bits | i)
            else:
                rank[i] = -1
            h = prv[i]
            if h >= 0:
                r = rank[h] = ranks[sym[h]].get(new, -1)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return [s for s in sym if s >= 0]

    def _word(self, w: str) -> tuple[int, ...]:
        return tuple(self.merge(w.encode()))

    def _chunk(self, piece: str) -> tuple[int, ...]:
        words = self.word_ids
        return tuple(chain.from_iterable([words[w] for w in self.words.findall(" " + piece)]))

    def _plain(self, text: str):
        """Ids in parts. A space before a visible character always begins a pre-token, so such texts are cut there
        and whole chunks are remembered; other texts go through the pattern as they are."""
        words = self.word_ids
        if any(s in text for s in (SPACE_PAIRS[:7] if text.isascii() else SPACE_PAIRS)) or text.endswith(" "):
            return [words[w] for w in self.words.findall(text)]
        first, *rest = text.split(" ")
        chunks = self.chunk_ids
        return [*[words[w] for w in self.words.findall(first)], *[chunks[c] for c in rest]]

    def ids(self, text: str) -> list[int]:
        if not any(s in text for s in self.added):
            return list(chain.from_iterable(self._plain(text)))
        parts = []
        for piece in self.split.split(text):
            parts += [(self.added[piece],)] if piece in self.added else self._plain(piece)
        return list(chain.from_iterable(parts))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_ids): the ids of every whole text; null and empty texts give an empty list."""
    d = pick(df, key, text)
    shared = d.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary file: a fixed size

    def run(batches):
        t = shared.value
        for b in batches:
            ids = [t.encode(x.as_py() or "") for x in b.column(1)]
            ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int64)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.LargeListArray.from_arrays(pa.array(ends), values).cast(pa.list_(pa.int32()))], [key, "token_ids"])

    kind = d.schema[key].dataType.simpleString()
    return d.mapInArrow(run, f"`{key}` {kind}, token_ids array<int>")


def decode(df: DataFrame, tokenizer: Tokenizer, keep: list[str], ids: str = "token_ids") -> DataFrame:
    """The kept columns and ``decoded``, the concatenated vocabulary strings; null ids give an empty text."""
    d = pick(df, *keep, ids)
    shared = d.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        t = shared.value
        for b in batches:
            lists = b.column(len(keep))
            out = [t.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], [*keep, "decoded"])

    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keep)
    return d.mapInArrow(run, f"{kinds}, decoded string")


def encode_checked(df: DataFrame, tokenizer: Tokenizer, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``n_tokens``, ``token_ids`` and ``exact``: whether decoding the ids gives the text back."""
    d = pick(df, *keep, text)
    shared = d.sparkSession.sparkContext.broadcast(tokenizer)
    names = [*keep, "n_tokens", "token_ids", "exact"]

    def run(batches):
        t = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                s = b.slice(lo, 200)
                ids, exact = [], []
                for x in s.column(len(keep)).to_pylist():
                    i = t.ids(x or "")
                    exact.append(t.decode(i) == (x or ""))
                    ids.append(np.array(i, np.int32))
                ends = np.cumsum([0] + [len(i) for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                cols = [*s.columns[: len(keep)], pa.array(np.diff(ends), pa.int64()), lists, pa.array(exact)]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keep)
    return d.mapInArrow(run, f"{kinds}, n_tokens long, token_ids array<int>, exact boolean")


def round_trip(df: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of encoding and decoding: (key, n_tokens, ids_sha256, decoded_sha256); one text at a time is in memory."""
    d = pick(df, key, text)
    shared = d.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        t = shared.value
        decimal = [str(i) for i in range(max(t.bytes) + 1)].__getitem__
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for x in b.column(1):
                ids = t.ids(x.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"`{key}` {d.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
