"""Vectorised word hashing over UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered.
Its hash takes eight bytes at a time through a 64-bit mixer, so words of one
length up to eight bytes never share a hash, and longer ones only as random
64-bit numbers do; words over ``LONG_WORD`` bytes are hashed by BLAKE2.  Where
equal hashes must mean equal bytes, callers compare the bytes (``tokenmemo``).
Everything is numpy over chunks of about 256 KB.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

CHUNK = 1 << 18
BATCH_ROWS = 2000
LONG_WORD = 256
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Masks of the first 0 to 8 bytes of a little-endian lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    edge = np.empty(len(data) + 1, np.int8)
    if len(data):
        body = (~_SPACE[data]).view(np.int8)
        edge[0], edge[-1] = body[0], -body[-1]
        np.subtract(body[1:], body[:-1], out=edge[1:-1])
    else:
        edge[0] = 0
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Lanes:
    """Eight bytes from any place of an array, as one number."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.data, self.view = data, np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def at(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ``size`` bytes (at most 8 are taken) from each place."""
        return self.view[place] & _FIRST[np.minimum(size, 8)]


def span_hashes(lanes: Lanes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes s..e-1 of each span."""
    size = e - s
    h = mix(lanes.at(s, size) + size.astype(_U) * _U(0xD6E8FEB86659FD93))
    left, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        more = lanes.at(s[left] + at, size[left] - at)
        h[left] = mix(h[left] * _U(0xE7037ED1A0B428DB) ^ more)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(blake2b(lanes.data[s[i] : e[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start byte) of every word of a uint8 array, in order."""
    hs, ss, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            cut = np.flatnonzero(_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a single word longer than a chunk
                while end < n and not len(cut := np.flatnonzero(_SPACE[data[end : end + CHUNK]])):
                    end = min(n, end + CHUNK)
                end = end + int(cut[0]) + 1 if end < n else n
        s, e = word_spans(data[at:end])
        hs.append(span_hashes(Lanes(_LOWER[data[at:end]]), s, e))
        ss.append(s + at)
        at = end
    return (np.concatenate(hs), np.concatenate(ss)) if hs else (np.empty(0, _U), np.empty(0, np.int64))


def word_hash(word: str) -> int:
    return int(word_hashes(np.frombuffer(word.encode(), np.uint8))[0][0])


def small_batches(spark) -> None:
    """Send whole texts to Python in Arrow batches of at most ``BATCH_ROWS`` rows, unless fewer are set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one uint8 array, each followed by a newline, and n+1 offsets."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=off[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), off


def blocks(ids: list, texts: list, limit: int = CHUNK):
    """Cut a batch into runs of rows with about ``limit`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield ids[lo : i + 1], texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def doc_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and n+1 offsets of each text's words."""
    data, off = joined(texts)
    h, s = word_hashes(data)
    return h, np.searchsorted(s, off)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of one text's k-word shingles; shorter texts give one, empty ones none."""
    n = len(h)
    if n == 0:
        return np.empty(0, _U)
    w = min(k, n)
    acc = np.full(n - w + 1, w * 0xA0761D6478BD642F & (1 << 64) - 1, _U)
    for j in range(w):
        acc = mix(acc + h[j : n - w + 1 + j]) * _U(0xE7037ED1A0B428DB)
    return np.unique(acc)
