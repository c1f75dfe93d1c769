"""Fast batch encoding with the tokenizers library.

Tokenizers whose pre-tokenizer never lets a token cross white space, and which
lower their input, give the same ids for a text as for its white-space
separated words in order; a full stop or comma after a letter at a word's end
is a token of its own.  So each distinct word is encoded once by the library
and kept in a memo of bounded size, and a text's ids are gathered with numpy.

The memo finds words (A-Z lowered) by a 64-bit hash and compares their bytes,
so a word gets its own ids whatever its hash; a word whose hash another word
holds is kept in a dictionary beside the table.  New words are sent to the
library a thousand at a time, joined by spaces, and split again at tokens that
end a word; a batch in which the count of such tokens is not as expected is
encoded word by word.  Texts that hold ``<|`` (where a special token may match
inside) go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .texthash import LONG_WORD, Lanes, joined, lowered, span_hashes, word_spans

MEMO_WORDS, MEMO_BYTES = 600_000, 1 << 26
LONG = 1 << 22
_U = np.uint64
_OPEN: dict[str, "WordMemo"] = {}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class HashTable:
    """uint64 keys with an int32 value each; linear probing, grown at half load."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, _U)
        self.values = np.zeros(1 << bits, np.int32)

    def _home(self, k: np.ndarray) -> np.ndarray:
        return (k >> _U(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Value of each key (none is 0), or -1."""
        out = np.full(len(k), -1, np.int32)
        slot = self._home(k)
        held = self.keys[slot]
        hit = held == k
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == k[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, k: np.ndarray, v: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        if (self.count + len(k)) * 2 > 1 << self.bits:
            used = self.keys != 0
            keys, values = self.keys[used], self.values[used]
            while (self.count + len(k)) * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int32)
            self._place(keys, values)
        self._place(k, v)
        self.count += len(k)

    def _place(self, k: np.ndarray, v: np.ndarray) -> None:
        slot = self._home(k)
        while len(k):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[slot[own]], self.values[slot[own]] = k[own], v[own]
            rest = np.ones(len(k), bool)
            rest[own] = False
            k, v, slot = k[rest], v[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


class ByteTable:
    """Byte strings, each with a small tag, numbered as they come; equal numbers mean equal bytes and tags."""

    def __init__(self):
        self.table, self.other = HashTable(), {}
        self.count = self.used = 0
        self.raw = np.zeros(1 << 20, np.uint8)
        self.start, self.size, self.tag = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int8)
        self.head = np.zeros(1 << 16, _U)

    def number(self, lanes: Lanes, s: np.ndarray, e: np.ndarray, tag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span's bytes, and the places of spans that hold the bytes of the new numbers, in order."""
        tag = np.zeros(len(s), np.int8) if tag is None else tag
        keys = span_hashes(lanes, s, e)
        keys += tag.astype(_U) * _U(0x9E3779B97F4A7C15)
        keys[keys == 0] = 1
        at = self.table.find(keys).astype(np.int64)
        fresh = []
        if len(miss := np.flatnonzero(at < 0)):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            numbers = self._keep(lanes, s, e, tag, miss[first])
            self.table.add(new, numbers.astype(np.int32))
            at[miss] = numbers[back]
            fresh.append(miss[first])
        for i in np.flatnonzero(~self._same(lanes, s, e, tag, at)):  # another string has this hash
            word = (lanes.data[s[i] : e[i]].tobytes(), int(tag[i]))
            if word not in self.other:
                self.other[word] = int(self._keep(lanes, s, e, tag, np.array([i]))[0])
                fresh.append(np.array([i]))
            at[i] = self.other[word]
        return at, np.concatenate(fresh) if fresh else np.empty(0, np.int64)

    def _keep(self, lanes: Lanes, s, e, tag, which: np.ndarray) -> np.ndarray:
        size = (e - s)[which]
        need, count = self.used + int(size.sum()), self.count + len(which)
        if need > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(need, np.uint8)])
        if count > len(self.start):
            self.start, self.size, self.tag, self.head = (np.concatenate([x, np.zeros(count, x.dtype)]) for x in (self.start, self.size, self.tag, self.head))
        to = np.cumsum(size) - size
        self.raw[self.used : need] = lanes.data[np.repeat(s[which] - to, size) + np.arange(int(size.sum()))]
        own = np.arange(self.count, count)
        self.start[own], self.size[own], self.tag[own], self.head[own] = self.used + to, size, tag[which], lanes.at(s[which], size)
        self.used, self.count = need, count
        self.lanes = Lanes(self.raw[: self.used])
        return own

    def _same(self, lanes: Lanes, s, e, tag, at: np.ndarray) -> np.ndarray:
        size = e - s
        ok = (self.size[at] == size) & (self.tag[at] == tag) & (self.head[at] == lanes.at(s, size))
        left, k = np.flatnonzero(ok & (size > 8) & (size <= LONG_WORD)), 8
        while len(left):
            rest = size[left] - k
            same = lanes.at(s[left] + k, rest) == self.lanes.at(self.start[at[left]] + k, rest)
            ok[left[~same]] = False
            k += 8
            left = left[same & (rest > 8)]
        for i in np.flatnonzero(ok & (size > LONG_WORD)):
            a = self.start[at[i]]
            ok[i] = np.array_equal(lanes.data[s[i] : e[i]], self.raw[a : a + size[i]])
        return ok


class WordMemo:
    def __init__(self, path: str, end_mark: str = "</w>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end_mark)]] = True
        self.clear()

    def clear(self) -> None:
        self.table = ByteTable()
        self.flat, self.filled = np.empty(1 << 20, np.uint16 if len(self.ends) < 1 << 16 else np.uint32), 0
        self.start, self.size = np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], held: int) -> None:
        """Encode new words and store their ids from number ``held`` on."""
        texts = b" ".join(words).decode("utf-8", "surrogatepass").lower().split(" ")
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if not t.isalpha()]
        parts, sizes, where = [], [], []
        for lo in range(0, len(plain), 1000):
            some = plain[lo : lo + 1000]
            ids = np.array(self._encode([" ".join([texts[i] for i in some])])[0], self.flat.dtype)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some) or last[-1] != len(ids):
                other += some
                continue
            parts.append(ids)
            sizes.append(np.diff(last, prepend=0))
            where += some
        if other:
            got = self._encode([texts[i] for i in other])
            parts += [np.array(g, self.flat.dtype) for g in got]
            sizes.append(np.array([len(g) for g in got], np.int64))
            where += other
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        at = held + np.array(where)
        need = held + len(words)
        if need > len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty(need, np.int32)]) for a in (self.start, self.size))
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(self.filled + len(flat), self.flat.dtype)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.start[at], self.size[at] = self.filled + np.cumsum(size) - size, size
        self.filled += len(flat)

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n+1 offsets; ``end_id`` closes each text."""
        if any(t and len(t) > LONG for t in texts):
            return self._encode_long(texts, end_id)
        if self.table.count > MEMO_WORDS or self.table.used > MEMO_BYTES:
            self.clear()
        whole = {i: t for i, t in enumerate(texts) if t and "<|" in t}
        data, off = joined([None if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        data = lowered(data)
        s, e = word_spans(data)
        # a full stop or comma after a letter at the end of a word is cut off
        final = data[e - 1]
        cut = np.flatnonzero(((final == 44) | (final == 46)) & (e - s >= 3))
        before = data[e[cut] - 2]
        latin = (data[e[cut] - 3] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut = cut[_LETTER[before] | latin]
        times = np.ones(len(s), np.int64)
        times[cut] = 2
        place = np.cumsum(times) - times
        us, ue = np.repeat(s, times), np.repeat(e, times)
        ue[place[cut]] -= 1
        us[place[cut] + 1] = ue[place[cut]]
        held = self.table.count
        at, new = self.table.number(Lanes(data), us, ue)
        if len(new):
            view = data.tobytes()
            self._add([view[x:y] for x, y in zip(us[new].tolist(), ue[new].tolist())], held)
        size = self.size[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        step = np.ones(total[-1], np.int32)
        some = np.flatnonzero(size)
        if len(some):  # gather by running sums of jumps, cheaper than repeating starts
            src = self.start[at[some]]
            step[0] = src[0]
            step[total[some[1:]]] = src[1:] - (src[:-1] + size[some[:-1]] - 1)
        ids = self.flat[np.cumsum(step, dtype=np.int64)].astype(np.uint32) if len(some) else np.empty(0, np.uint32)
        bound = total[np.searchsorted(us, off)]
        extra = int(end_id is not None)
        if not whole and not extra:
            return ids, bound
        direct = dict(zip(whole, self._encode(list(whole.values())))) if whole else {}
        sizes = np.diff(bound)
        for i, d in direct.items():
            sizes[i] = len(d)
        to = np.concatenate([[0], np.cumsum(sizes + extra)])
        out = np.empty(to[-1], np.uint32)
        own = np.ones(len(out), bool)
        if extra:
            out[to[1:] - 1] = end_id
            own[to[1:] - 1] = False
        for i, d in direct.items():
            out[to[i] : to[i] + len(d)] = d
            own[to[i] : to[i] + len(d)] = False
        out[own] = ids
        return out, to


    def _encode_long(self, texts: list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts longer than ``LONG``: in parts that end at white space, so memory stays bounded."""
        parts, sizes = [], [0]
        for t in texts:
            own = []
            for part in cut_at_blanks(t or "", LONG):
                own.append(self._encode([part])[0] if len(part) > LONG else self.encode([part])[0])
            if end_id is not None:
                own.append(np.array([end_id]))
            parts += [np.asarray(o, np.uint32) for o in own]
            sizes.append(sum(map(len, own)))
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.cumsum(sizes)


def cut_at_blanks(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters that end at a blank or line end; a longer word stays whole.

    A part with ``<|`` is not cut: the text comes back in one piece.
    """
    if "<|" in text:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        end = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if end < at:
            ends = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            if not ends:
                break
            end = min(ends)
        out.append(text[at : end + 1])
        at = end + 1
    return [*out, text[at:]]


def word_memo(path: str) -> WordMemo:
    """This process's memo for a tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = WordMemo(path)
    return _OPEN[path]
