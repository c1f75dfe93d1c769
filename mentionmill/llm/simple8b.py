"""Simple-8b word-aligned coding of integers, vectorised with numpy.

A 64-bit word holds a 4-bit selector (its top bits) and as many values of one
width as fit in 60 bits.  Values are coded in blocks; each block starts at a
word of its own, and its offset is stored, so all blocks are coded and decoded
at once by array operations.  Selector 0 is the escape: the next word is one
raw 64-bit value (for values of 2**60 or more).

File image (little-endian):

    magic "S8BT", version u32, documents without an id u64 (they come first), documents u64, values u64, words u64, blocks u64
    document ids   i64[documents]
    document ends  u64[documents]   exclusive, counted in values
    block offsets  u64[blocks + 1]  counted in words
    words          u64[words]

Every block but the last holds BLOCK values.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
#: Fixed values: (count, width in bits) of selectors 1 to 14.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = b"S8BT"
_HEAD = struct.Struct("<4sIQQQQQ")
_U = np.uint64


_SMALL = np.searchsorted(np.array([(1 << w) - 1 for _, w in PACKINGS], np.int64), np.arange(1 << 16), "left").astype(np.int8) + np.int8(1)


def _widths(v: np.ndarray) -> np.ndarray:
    """Selector (1 to 14, 15 for an escape) that a value needs by itself."""
    if len(v) and int(v.max()) < 1 << 16:
        return _SMALL[v]
    limits = np.array([(1 << w) - 1 for _, w in PACKINGS], _U)
    return (np.searchsorted(limits, v, "left") + 1).astype(np.int8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets) of an array of unsigned integers."""
    v = np.asarray(values)
    n = len(v)
    nb = -(-n // BLOCK)
    if not n:
        return np.empty(0, _U), np.zeros(1, np.int64)
    need = _widths(v)
    end = np.minimum((np.arange(nb) + 1) * BLOCK, n)
    # best[i]: the first selector whose run of values from i all fit (a run may be cut by the block's end)
    best, step, over = np.full(n, 15, np.int8), np.ones(n, np.int16), np.zeros(n + 1, np.int32)
    for s, (count, _) in enumerate(PACKINGS, 1):
        at = np.flatnonzero((need <= s) & (best == 15))
        if not len(at):
            continue
        np.cumsum(need > s, out=over[1:])
        last = np.minimum(at + count, np.minimum(at - at % BLOCK + BLOCK, n))
        ok = over[last] == over[at]
        at, last = at[ok], last[ok]
        best[at] = s
        step[at] = last - at
    # follow the runs of all blocks at once
    at, stop, first = np.arange(nb) * BLOCK, end, np.zeros(n, bool)
    while len(at):
        first[at] = True
        at = at + step[at]
        keep = at < stop
        at, stop = at[keep], stop[keep]
    starts = np.flatnonzero(first)
    sel = best[starts]
    used = np.where(sel == 15, 2, 1)
    place = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), _U)
    padded = np.concatenate([v.astype(_U), np.zeros(PACKINGS[0][0], _U)])
    for s, (count, width) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        at, size = starts[mine], step[starts[mine]]
        got = np.full(len(at), s << 60, _U)
        for j in range(count):
            x = padded[at + j] << _U(j * width)
            if j:
                x[size <= j] = 0
            got |= x
        words[place[mine]] = got
    raw = np.flatnonzero(sel == 15)
    words[place[raw] + 1] = v[starts[raw]]
    offsets = np.zeros(nb + 1, np.int64)
    np.cumsum(np.bincount(starts // BLOCK, used, nb).astype(np.int64), out=offsets[1:])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of ``pack``; every block is decoded from its own offset."""
    out = np.zeros(n, _U)
    if not n:
        return out
    sel = (words >> _U(60)).astype(np.int64)
    # a word after an escape is raw whatever its top bits are; they are few, and follow in order
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0):
        if not raw[i]:
            raw[i + 1] = True
    count = np.array([1, *(c for c, _ in PACKINGS), 0])[sel]
    count[raw] = 0
    nb = len(offsets) - 1
    block = np.repeat(np.arange(nb), np.diff(offsets))
    before = np.cumsum(count) - count
    start = before - before[offsets[:-1]][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(1, 15):
        at = np.flatnonzero((sel == s) & ~raw)
        if len(at):
            c, width = PACKINGS[s - 1]
            got = (words[at][:, None] >> (np.arange(c, dtype=_U) * _U(width))) & _U((1 << width) - 1)
            col = start[at][:, None] + np.arange(c)
            inside = col < end[at][:, None]
            out[col[inside]] = got[inside]
    esc = np.flatnonzero((sel == 0) & ~raw)
    out[start[esc]] = words[esc + 1]
    return out


def to_bytes(doc_ids: np.ndarray, ends: np.ndarray, values: np.ndarray, nulls: int = 0) -> bytes:
    """The file image of some documents' values; the first ``nulls`` documents have no id."""
    words, offsets = pack(values)
    head = _HEAD.pack(MAGIC, 2, nulls, len(doc_ids), len(values), len(words), len(offsets) - 1)
    parts = (np.asarray(doc_ids, "<i8"), np.asarray(ends, "<u8"), offsets.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def null_ids(image: bytes) -> int:
    """How many documents at the start of a file have no id."""
    return _HEAD.unpack_from(image)[2]


def from_bytes(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ends, values) of a file image."""
    magic, version, nulls, docs, n, nw, nb = _HEAD.unpack_from(image)
    if magic != MAGIC or version != 2 or nulls > docs:
        raise ValueError("not a token file of version 2")
    at = _HEAD.size
    ids = np.frombuffer(image, "<i8", docs, at)
    ends = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
    offsets = np.frombuffer(image, "<u8", nb + 1, at + 16 * docs).astype(np.int64)
    words = np.frombuffer(image, "<u8", nw, at + 16 * docs + 8 * (nb + 1))
    if len(image) != at + 16 * docs + 8 * (nb + 1) + 8 * nw:
        raise ValueError("token file is cut short")
    return ids, ends, unpack(words, offsets, n)
