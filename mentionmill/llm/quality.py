"""Quality: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Every word of a text has a content (its bytes, A-Z lowered) and a form (its
letters as upper or lower case, digits, and its other characters as they are,
each run of one kind cut to two, with a mark where the word repeats the one
before it).  Contents and forms are hashed into ``CONTENTS`` and ``FORMS`` units.
Each unit has an index vector, sparse and ternary, made from its number alone.
A unit's word vector is the sum of the index vectors of what it stands beside,
over all texts: for contents the two words on either side and the own form, for
forms the two forms on either side.  Tasks sum their own texts and Spark sums the
tasks' rows, so the corpus is read once and nothing but the table of fixed size
reaches the driver.  A text is the mean of its words' unit vectors, contents and
forms apart, and its length.

The network (one hidden layer of tanh) is fitted in numpy on at most about
``SAMPLE`` labelled rows; a fifth of them is kept out of the fit and sets the
temperature that its logits are divided by.  Word vectors take no labels.

Null and empty texts have no words and are scored as texts of length 0.  Without
any labelled row every score is 0; with one class only, every score is that
class.  Rows are kept as they come, repeated ones too; only the named columns are
read, and kept columns may have any name.  Texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import quoted
from .language_id import beside, sample_rows
from .texthash import _SPACE, Lanes, blocks, joined, lowered, mix, small_batches, span_hashes, word_spans

SAMPLE, CONTENTS, FORMS, DIM, NONZERO = 16_384, 1 << 13, 1 << 10, 64, 2
UNITS = CONTENTS + FORMS
#: Keys held before they are counted.
HELD = 1 << 22
HIDDEN, EPOCHS, BATCH, RATE, DECAY, OUT = 32, 80, 128, 4e-3, 1e-3, 5
_U = np.uint64
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = _KIND[128:] = 97
_KIND[48:58] = 48


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content and form unit of every word, and n+1 offsets of each text's words."""
    data, off = joined(texts)
    s, e = word_spans(data)
    at = np.searchsorted(s, off)
    h = span_hashes(Lanes(lowered(data)), s, e)
    kind = _KIND[data]
    third = np.zeros(len(data), bool)  # a byte whose two before it, of the same word, are of its kind
    third[2:] = (kind[2:] == kind[1:-1]) & (kind[1:-1] == kind[:-2])
    keep = ~third | _SPACE[data]
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(Lanes(kind[keep]), place[s], place[e])
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    first = at[:-1][at[:-1] < len(h)]
    again[first] = False
    shape = np.where(again, mix(shape ^ _U(0x9E3779B97F4A7C15)), shape)
    return (h >> _U(64 - 13)).astype(np.int64), CONTENTS + (shape >> _U(64 - 10)).astype(np.int64), at


def index_vectors() -> np.ndarray:
    """For each unit its ``NONZERO`` places in a vector: d for +1 there, DIM + d for -1."""
    h = mix(np.arange(UNITS * NONZERO, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0xD1B54A32D192ED03))
    return (h >> _U(40)).astype(np.int64).reshape(UNITS, NONZERO) % (2 * DIM)


def contexts(texts: list[str | None], index: np.ndarray) -> np.ndarray:
    """A key (unit * 2 DIM + place) for each addition to a word vector."""
    content, form, at = units(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(at))
    keys = [content[:, None] * (2 * DIM) + index[form]]
    for gap in (1, 2):
        same = np.flatnonzero(own[gap:] == own[:-gap])
        for u in (content, form):
            a, b = u[same], u[same + gap]
            keys += [a[:, None] * (2 * DIM) + index[b], b[:, None] * (2 * DIM) + index[a]]
    return np.concatenate([k.ravel() for k in keys])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors (``UNITS`` rows of whole numbers, then scaled to length 4096) over all texts."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("unit", pa.int32()), *[(f"v{d}", pa.int64()) for d in range(DIM)]])

    def run(batches):
        index, held, size = index_vectors(), [], 0
        total = np.zeros(UNITS * 2 * DIM, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, part in blocks(texts, texts):
                held.append(contexts(part, index))
                size += len(held[-1])
                if size >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        sums = total.reshape(UNITS, 2, DIM)
        sums = sums[:, 0] - sums[:, 1]
        some = np.flatnonzero(sums.any(1))
        yield pa.record_batch([pa.array(some, pa.int32()), *[pa.array(sums[some, d]) for d in range(DIM)]], schema=schema)

    ddl = "unit int, " + ", ".join(f"v{d} long" for d in range(DIM))
    text = docs.select(F.col(quoted(text_col)).alias("text"))
    got = text.mapInArrow(run, ddl).groupBy("unit").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)]).toArrow()  # UNITS rows at most
    out = np.zeros((UNITS, DIM))
    if got.num_rows:
        out[got.column("unit").to_numpy()] = np.stack([got.column(f"v{d}").to_numpy() for d in range(DIM)], 1)
    for part in (out[:CONTENTS], out[CONTENTS:]):  # what all units share tells nothing
        some = part.any(1)
        part[some] /= np.linalg.norm(part[some], axis=1)[:, None]
        if some.any():
            part[some] -= part[some].mean(0)
            part[some] /= np.maximum(np.linalg.norm(part[some], axis=1), 1e-9)[:, None]
    return np.round(out * 4096).astype(np.int32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean content and form vectors and length; sums are of whole numbers, so no other text matters."""
    content, form, at = units(texts)
    n = np.diff(at)
    out = np.zeros((len(texts), 2 * DIM + 1))
    some = np.flatnonzero(n)
    if len(some):
        for k, u in enumerate((content, form)):
            out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[u], at[some], axis=0, dtype=np.int64) / (4096.0 * n[some, None])
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Two layers, fitted by Adam on the logistic loss with weight decay."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.shift) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            rate = RATE * (1 - epoch / EPOCHS)
            for lo in range(0, len(y), BATCH):
                b = order[lo : lo + BATCH]
                hidden = np.tanh(x[b] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[b]) / len(b)
                back = np.outer(g, w[2]) * (1 - hidden**2)
                grads = [x[b].T @ back + DECAY * w[0], back.sum(0), hidden.T @ g + DECAY * w[2], np.array([g.sum()])]
                step += 1
                for k, d in enumerate(grads):
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i, row in enumerate((x - self.shift) / self.scale):  # row by row: a product's rounding may depend on its shape
            out[i] = np.tanh(row @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]
        return out


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least logistic loss, by a search over a logarithmic grid that narrows.

    Targets are drawn in by one row of the other kind, so rows that are told apart
    without a fault do not ask for endless certainty.
    """
    lo, hi = np.log(0.25), np.log(64.0)
    n = y.sum()
    aim = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    for _ in range(4):
        grid = np.linspace(lo, hi, 17)
        loss = [(np.logaddexp(0, logit / np.exp(t)) - aim * logit / np.exp(t)).mean() for t in grid]
        k = int(np.argmin(loss))
        lo, hi = grid[max(0, k - 1)], grid[min(16, k + 1)]
    return float(np.exp((lo + hi) / 2))


class Quality:
    def __init__(self, vectors: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.vectors, self.net, self.heat, self.base = vectors, None, 1.0, float(y.mean()) if len(y) else 0.0
        fit = np.arange(len(y)) % OUT != 0
        if 0 < self.base < 1 and 0 < y[fit].sum() < fit.sum():
            self.net = Network(x[fit], y[fit])
            self.heat = temperature(self.net.logit(x[~fit]), y[~fit])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(self.net.logit(pooled(texts, self.vectors)) / self.heat, -30, 30)))


def learn(docs: DataFrame, labelled: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Quality:
    """Word vectors of all ``docs``; the network is fitted on ``labelled`` rows (id, text) with ``labels`` (id, label).

    The caller leaves held-out rows out of ``labelled`` and ``labels``.  Rows whose
    id or label is null teach nothing; of repeated labels the highest counts.
    """
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("double").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    known = sample_rows(known, "id", most)  # a bounded number of ids, so it may be broadcast
    rows = labelled.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(known), "id").select("y", "text")
    schema = pa.schema([("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def extract(batches):
        for batch in batches:
            for y, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.record_batch([pa.array(y, pa.float64()), pa.array(pooled(texts, vectors).tolist(), schema.field("x").type)], schema=schema)

    got = rows.mapInArrow(extract, "y double, x array<double>").toArrow()  # 2 DIM + 1 numbers for each sampled row
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM + 1)
    y = (got.column("y").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.zeros(0, int)  # the fit does not depend on the order of tasks
    order = order[np.random.default_rng(5).permutation(len(order))]
    return Quality(vectors, x[order], y[order])


def score(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """``score`` (0 to 1) beside the id, or beside the columns named in ``keep``; with ``into``, in a struct of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table of word vectors and a small network

    def predict(texts):
        parts = [shared.value.score(part) for _, part in blocks(texts, texts)]
        return [pa.array(np.concatenate(parts) if parts else [], pa.float64())]

    return beside(docs, keep or [id_col], text_col, predict, "score double", into)
