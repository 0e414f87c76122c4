"""Vectorised words, shingles and hashes of byte strings inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEPARATORS = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 17
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit integers so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t = np.ones(size, np.uint64)
            have = 1
            while have < size:
                t[have : 2 * have] = t[:have] * np.uint64(pow(b, have, 1 << 64))
                have *= 2
            _powers[k] = t
    return _powers[0], _powers[1]


def _slice_words(buf: np.ndarray, fold: bool, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    sep = _IS_SEP[buf]
    edge = np.diff(sep.view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if head:
        ends = np.minimum(ends, starts + head)
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf] if fold else buf] * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return starts, mix(h)


def words(buf: np.ndarray, fold: bool = True, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts, 64-bit hashes) of the words of one byte array, whatever its length; of their first bytes with ``head``."""
    starts, hashes, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(buf):
        hi = min(len(buf), lo + CHUNK)
        if hi < len(buf):
            cut = np.flatnonzero(_IS_SEP[buf[lo:hi]])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
            else:  # one word longer than a slice
                rest = np.flatnonzero(_IS_SEP[buf[hi:]])
                hi = hi + int(rest[0]) + 1 if len(rest) else len(buf)
        s, h = _slice_words(buf[lo:hi], fold, head)
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(starts), np.concatenate(hashes)


def document_prefixes(texts: list[bytes], head: int) -> Iterator[np.ndarray]:
    """Hashes of the first bytes of each word."""
    return document_words(texts, head=head)


def document_words(texts: list[bytes], fold: bool = True, head: int = 0) -> Iterator[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    group: list[bytes] = []
    size = 0

    def flush():
        starts, h = words(np.frombuffer(b"\n".join(group), np.uint8), fold, head)
        at = np.cumsum([0] + [len(t) + 1 for t in group])
        cut = np.searchsorted(starts, at)
        return [h[i:j] for i, j in zip(cut[:-1], cut[1:])]

    for t in texts:
        if size + len(t) > CHUNK and group:
            yield from flush()
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield from flush()


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words form one shingle, no words none."""
    if not len(w):
        return w
    m = min(n, len(w))
    k = len(w) - m + 1
    h = np.full(k, m, np.uint64)
    for j in range(m):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[j : j + k]
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]
