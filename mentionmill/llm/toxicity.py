"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities and counts of lexicon words, lexicon stems
and obfuscated lexicon words, how close they stand to second-person words,
rates of capitals, shouting words, exclamation and other punctuation, digits
and symbols inside words, and length.

The lexicon is a short fixed list plus words and stems (the first 4, 5 and 6
bytes of longer words) that are learned by log odds from labelled training
texts.  Trees are fitted by Newton boosting on histograms, in numpy, on a sample of
at most about ``SAMPLE`` labelled rows; the calibration is fitted on scores from
cross-fitting.  Scoring runs in Arrow batches.

Null and empty texts are scored like any other (all features 0).  Without any
labelled row every score is 0.  Rows are kept as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import Scratch
from .language_id import beside, sample_rows
from .texthash import blocks, joined, small_batches, word_hash, word_hashes

SAMPLE, LEXICON, MIN_ODDS, NEAR, LEAST = 16_384, 4096, 2.5, 6, 0.3
#: Insults in English.
INSULTS = "idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb fool jerk imbecile filthy vermin".split()
#: Second-person words in English, French, German and Spanish.
SECOND = "you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()
#: Characters written for letters.
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
FEATURES = 18
_U = np.uint64

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:256] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_LEET = _PLAIN.copy()
_LEETED = np.zeros(256, bool)
for _a, _b in SWAPS.items():
    _LEET[ord(_a)] = ord(_b)
    _LEETED[ord(_a)] = True


def _stream(data: np.ndarray, off: np.ndarray, keep: np.ndarray, table: np.ndarray):
    """Word hashes, their stem keys and text offsets of the bytes that are kept."""
    kept = table[data[keep]]
    place = np.concatenate([[0], np.cumsum(keep)])[off]
    h, s = word_hashes(kept)
    return kept, h, s, np.searchsorted(s, place)


def _stems(kept: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Keys of the first 4, 5 and 6 bytes of each word, 0 where it is not longer than that."""
    out = np.zeros((len(s), 3), np.int64)
    if not len(s):
        return out
    padded = np.concatenate([kept, np.full(8, 32, np.uint8)])
    byte = padded[s[:, None] + np.arange(7)].astype(np.int64)
    inside = ~np.logical_or.accumulate(_SPACES[byte.astype(np.uint8)], axis=1)
    key = np.zeros(len(s), np.int64)
    for j in range(6):
        key |= byte[:, j] << (8 * j)
        if j >= 3:
            out[:, j - 3] = np.where(inside[:, j + 1], key | (j + 1) << 48, 0)
    return out


def tokens_of(texts: list[str | None]):
    """For each text: the distinct keys of its words and stems, for learning a lexicon."""
    data, off = joined(texts)
    kept, h, s, at = _stream(data, off, _ALPHA[data] | _SPACES[data], _PLAIN)
    stems = _stems(kept, s)
    words = h.view(np.int64)
    for i in range(len(texts)):
        own = stems[at[i] : at[i + 1]].ravel()
        yield np.unique(words[at[i] : at[i + 1]]), np.unique(own[own != 0])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def features(texts: list[str | None], words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """Dense features, a row for each text; ``words`` and ``stems`` are the sorted lexicon keys."""
    data, off = joined(texts)
    kept, h, s, at = _stream(data, off, _ALPHA[data] | _SPACES[data], _PLAIN)
    n = np.diff(at).astype(float)
    some = np.maximum(n, 1)
    keys = h.view(np.int64)
    hit = np.isin(keys, words)
    stem = np.isin(_stems(kept, s), stems).any(1) if len(stems) else np.zeros(len(h), bool)
    second = np.isin(keys, _SECOND)
    bad = hit | stem
    # distance to the nearest second-person word of the same text
    where = np.flatnonzero(second)
    if len(where) and bad.any():
        b = np.flatnonzero(bad)
        right = np.searchsorted(where, b)
        text_of = np.repeat(np.arange(len(texts)), np.diff(at))
        gap = np.full(len(b), 1e9)
        for j in (right - 1, right):
            ok = (j >= 0) & (j < len(where))
            ok[ok] = text_of[where[j[ok]]] == text_of[b[ok]]
            gap[ok] = np.minimum(gap[ok], np.abs(where[j[ok]] - b[ok]))
        # summed text by text, so a text's sum does not depend on the others
        close = np.bincount(text_of[b], np.where(gap <= NEAR, 1 / (1 + gap), 0), len(texts))
    else:
        close = np.zeros(len(texts))
    # words that are in the lexicon only once look-alike characters are read as letters
    _, h2, _, at2 = _stream(data, off, _ALPHA[data] | _SPACES[data] | _LEETED[data], _LEET)
    masked = np.maximum(_sums(np.isin(h2.view(np.int64), words), at2) - _sums(hit, at), 0)
    letters = _sums(_ALPHA[data], off)
    marks = ~_ALPHA[data] & ~_SPACES[data] & ~_DIGIT[data]
    size = np.maximum(np.diff(off) - 1, 1)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = marks[1:-1] & _ALPHA[data[:-2]] & _ALPHA[data[2:]]
    run = np.zeros(len(data), bool)
    run[2:] = marks[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    hits, stem_hits = _sums(hit, at), _sums(bad, at)
    shout = _UPPER[data]
    shouted = np.zeros(len(data), bool)
    shouted[1:] = shout[1:] & shout[:-1]
    cols = [
        hits / some, np.log1p(hits), stem_hits / some, np.log1p(stem_hits), masked / some, np.log1p(masked),
        _sums(second, at) / some, close / np.maximum(stem_hits, 1), np.log1p(close),
        _sums(shout, off) / np.maximum(letters, 1), _sums(shouted, off) / np.maximum(letters, 1),
        _sums(data == 33, off) / size, _sums(data == 63, off) / size, _sums(marks, off) / size,
        _sums(_DIGIT[data], off) / size, _sums(inner, off) / size, _sums(run, off) / size, np.log1p(n),
    ]
    return np.stack(cols, 1)


_SECOND = np.sort(np.array([word_hash(w) for w in SECOND], _U).view(np.int64))
_FIXED = np.sort(np.array([word_hash(w) for w in INSULTS], _U).view(np.int64))


class Boosted:
    """Trees of one depth on binned features; logistic loss, Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        width, nf = bins + 1, x.shape[1]
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees, self.depth = float(np.log(p0 / (1 - p0))), [], depth
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, hs = p - y, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                k = 1 << level
                flat = (node[:, None] * nf + np.arange(nf)) * width + b
                gs = np.bincount(flat.ravel(), np.repeat(g, nf), k * nf * width).reshape(k, nf, width).cumsum(2)
                hh = np.bincount(flat.ravel(), np.repeat(hs, nf), k * nf * width).reshape(k, nf, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hh[:, :, -1:]
                gain = gs**2 / (hh + l2) + (gt - gs) ** 2 / (ht - hh + l2) - gt**2 / (ht + l2)
                gain = np.where((hh >= LEAST) & (ht - hh >= LEAST), gain, 0)[:, :, :-1]
                at = gain.reshape(k, -1).argmax(1)
                feature, cut = at // (width - 1), at % (width - 1)
                cut = np.where(gain.reshape(k, -1).max(1) > 1e-9, cut, width)  # nothing gained: all go left
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            k = 1 << depth
            leaf = -rate * np.bincount(node, g, k) / (np.bincount(node, hs, k) + l2)
            f += leaf[node]
            self.trees.append((splits, leaf))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, row = self._bin(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[row, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score knots, calibrated values), rising, smoothed by half a count at the ends."""
    order = np.argsort(score, kind="stable")
    blocks_: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks_.append([v, 1.0, s, s])
        while len(blocks_) > 1 and blocks_[-2][0] / blocks_[-2][1] >= blocks_[-1][0] / blocks_[-1][1]:
            last = blocks_.pop()
            blocks_[-1] = [blocks_[-1][0] + last[0], blocks_[-1][1] + last[1], blocks_[-1][2], last[3]]
    knots, values = [], []
    for total, n, lo, hi in blocks_:
        knots += [lo, hi]
        values += [(total + 0.5 * (total == 0)) / (n + 0.5)] * 2
    return np.array(knots), np.maximum.accumulate(np.array(values))


class Toxicity:
    def __init__(self, words: np.ndarray, stems: np.ndarray, x: np.ndarray, y: np.ndarray, folds: int = 3):
        self.words, self.stems, self.model = words, stems, None
        if len(y) == 0:
            return
        fold = np.arange(len(y)) % folds
        if len(y) >= 10 * folds and 0 < y.sum() < len(y):
            out = np.empty(len(y))
            for k in range(folds):
                out[fold == k] = Boosted(x[fold != k], y[fold != k]).score(x[fold == k])
            self.knots, self.values = isotonic(out, y)
        else:
            self.knots, self.values = np.array([0.0]), np.array([y.mean()])
        self.model = Boosted(x, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        return np.clip(np.interp(self.model.score(features(texts, self.words, self.stems)), self.knots, self.values), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Toxicity:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; the caller has left out held-out rows.

    Rows whose id or label is null teach nothing; of repeated labels the highest counts.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    known = sample_rows(known, "doc_id", most)  # a bounded number of ids, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("toxic", "text")
    rows = Scratch(docs.sparkSession, "toxicity").table(rows, "rows", narrow=True)  # the sample, read three times
    base = rows.groupBy("toxic").count().collect()
    n_pos, n_neg = (sum(r["count"] for r in base if (r.toxic > 0) == t) for t in (True, False))
    seen = pa.schema([("stem", pa.bool_()), ("key", pa.int64()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(batches):
        for batch in batches:
            for toxic, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, stems = zip(*tokens_of(texts))
                for is_stem, keys in ((False, words), (True, stems)):
                    flat = np.concatenate(keys)
                    w = np.repeat(np.array(toxic) > 0, [len(k) for k in keys])
                    u, inv = np.unique(flat, return_inverse=True)
                    pos = np.bincount(inv, w, len(u)).astype(np.int64)
                    yield pa.record_batch([pa.array([is_stem] * len(u)), pa.array(u), pa.array(pos), pa.array(np.bincount(inv, minlength=len(u)) - pos)], schema=seen)

    sums = rows.mapInArrow(count, "stem boolean, key long, pos long, neg long").groupBy("stem", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    best = sums.where((F.col("pos") >= max(4, n_pos // 100)) & (odds >= MIN_ODDS)).orderBy(odds.desc(), F.col("pos").desc(), "key").limit(LEXICON).collect()
    words = np.union1d(_FIXED, np.array([r.key for r in best if not r.stem], np.int64))
    stems = np.sort(np.array([r.key for r in best if r.stem], np.int64))
    dense = pa.schema([("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def extract(batches):
        for batch in batches:
            for toxic, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.record_batch([pa.array(toxic, pa.float64()), pa.array(features(texts, words, stems).tolist(), dense.field("x").type)], schema=dense)

    got = rows.mapInArrow(extract, "y double, x array<double>").toArrow()  # FEATURES doubles for each sampled row
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = (got.column("y").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.zeros(0, int)  # the fit does not depend on the order of tasks
    order = order[np.random.default_rng(5).permutation(len(order))]
    return Toxicity(words, stems, x[order], y[order])


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """``score`` (0 to 1) beside the id, or beside the columns named in ``keep``; with ``into``, in a struct of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON keys and some trees

    def predict(texts):
        parts = [shared.value.score(part) for _, part in blocks(texts, texts)]
        return [pa.array(np.concatenate(parts) if parts else [], pa.float64())]

    return beside(docs, keep or [id_col], text_col, predict, "score double", into)
