"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after a learned rotation (iterative
quantisation on a bounded sample; several rotations, each from its own start,
give about ``BITS`` bits; below ``FEW`` dimensions all but the first are random
and cut at quantiles of the sample).  A shard's codes are cut into substrings of
about log2(rows) bits, 8 to 16, and each substring has a directory: for each of
its 2**bits values where the rows that hold it stand.  To find every code within
Hamming radius r of a query, substring i is probed at radius s_i with
sum(s_i + 1) = r + 1: by the pigeonhole principle a code within r is within s_i
on some substring i.  A probe is a lookup in the directory for each value of its
ball; no probe reads the codes one by one.  What the probes give is compared as
whole codes, and the codes within r are reranked by Euclidean distance on the
original vectors.

r is learned from the sample: ``COVER`` of the sample's own nearest neighbours
have codes within it, as many of each as the k nearest of the whole table are on
average in the sample.  A query for which a shard has fewer than ``LEAST`` times k
codes within r is probed again at a larger radius.  A shard of vectors of a length that the sample
lacks learns its codes from its own vectors.

See ``vector_search`` for nulls, ties, repeated rows and extra columns.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .vector_search import search, usable

SAMPLE, BITS, COVER, ROUNDS, FEW = 4096, 128, 0.97, 12, 16
WIDTHS = 8, 16
#: Times k codes that are reranked at least.
LEAST = 4


class Codes:
    """Mean and rotations of one dimension, and the Hamming radius.

    ``share``: the part of all vectors that ``x`` is.
    """

    def __init__(self, x: np.ndarray, k: int, seed: int = 7, share: float = 1.0):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        z = x - self.mean
        basis = np.linalg.eigh(z.T @ z)[1][:, ::-1].T  # principal axes, the widest first
        z, d = z @ basis.T, x.shape[1]
        turns, cut = [], []
        for t in range(-(-BITS // d)):
            r, _ = np.linalg.qr(rng.standard_normal((d, d)))
            plain = t and d < FEW  # few axes have few good rotations; the others are cut at quantiles instead
            for _ in range(0 if plain else ROUNDS):  # best signs for the rotation, then best rotation for the signs
                u, _, vt = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
                r = (u @ vt).T
            turns.append(basis.T @ r)
            cut.append(np.array([np.quantile(c, q) for c, q in zip((z @ r).T, rng.random(d))]) if plain else np.zeros(d))
        turn, cut = np.hstack(turns), np.concatenate(cut)
        self.bits = max(64, len(cut) // 64 * 64) if len(cut) >= 64 else len(cut)
        self.turn, self.cut = turn[:, : self.bits], cut[: self.bits]
        codes, k = self.encode(x), max(1, min(round(k * share), len(x) - 1))
        seen = []
        for i in np.linspace(0, len(x) - 1, min(512, len(x))).astype(int):
            dist = ((x - x[i]) ** 2).sum(1)
            dist[i] = np.inf
            near = np.argsort(dist)[: k if len(x) > 1 else 0]
            seen.append(np.bitwise_count(codes[near] ^ codes[i]).sum(1, dtype=np.int64))
        seen = np.concatenate(seen) if seen else np.zeros(0)
        self.radius = int(np.quantile(seen, COVER, method="higher")) if len(seen) else self.bits

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((x - self.mean) @ self.turn >= self.cut, axis=1)


def cuts_of(bits: int, rows: int) -> np.ndarray:
    """Where codes of so many bits are cut, for an index of so many rows."""
    width = min(max(int(rows).bit_length(), WIDTHS[0]), WIDTHS[1])
    return np.linspace(0, bits, max(1, -(-bits // width)) + 1).astype(int)


def substrings(codes: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Each substring of the codes as a column of numbers."""
    bits = np.unpackbits(codes, axis=1)
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(cuts[:-1], cuts[1:])]


@cache
def ball(width: int, reach: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``reach`` ones."""
    return np.array([sum(1 << b for b in c) for j in range(min(reach, width) + 1) for c in combinations(range(width), j)], np.int64)


class MultiIndex:
    """A directory for each substring of one shard's codes; ``lookups`` counts the values looked up."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.cuts, self.lookups = codes, cuts_of(8 * codes.shape[1], len(codes)), 0
        self.widths = np.diff(self.cuts).tolist()
        parts = substrings(codes, self.cuts)
        self.rows = [np.argsort(part, kind="stable") for part in parts]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << w))]) for part, w in zip(parts, self.widths)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with some substring near enough; among them all whose code is within ``radius``."""
        base, more = divmod(radius + 1, len(self.widths))
        hit = np.zeros(len(self.codes), bool)
        for i, part in enumerate(substrings(code[None], self.cuts)):
            reach = base - 1 + (i < more)
            if reach >= 0:
                values = ball(self.widths[i], reach) ^ part[0]
                self.lookups += len(values)
                first = self.first[i][values]
                size = self.first[i][values + 1] - first
                some = np.flatnonzero(size)
                first, size = first[some], size[some]
                hit[self.rows[i][np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``: all of them."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]


def kernel(models: dict[int, Codes]):
    def run(uids, x, queries, bounds, k):
        model = models.get(x.shape[1]) or Codes(np.unique(x[:SAMPLE], axis=0), k)
        index = MultiIndex(model.encode(x))
        out = []
        for q, code, bound in zip(queries, model.encode(queries), bounds):
            radius = model.radius
            rows = index.within(code, radius)
            while len(rows) < min(LEAST * k, len(x)):
                radius = min(8 * len(code), radius + max(1, model.bits // 32))
                rows = index.within(code, radius)
            dist = np.sqrt(((x[rows] - q) ** 2).sum(1))
            if bound is not None:
                keep = dist <= bound
                rows, dist = rows[keep], dist[keep]
            top = np.lexsort((uids[rows], dist))[:k]
            out.append((uids[rows[top]], dist[top]))
        return out

    return run


def learn(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> dict[int, Codes]:
    """A model for each vector length among at most ``sample`` vectors, chosen by a hash of the id."""
    rows = usable(vectors, id_col, vec_col, nonzero=True)
    n = rows.count()
    slot = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    picked = rows.where(slot < F.lit(int(min(1.0, 0.9 * sample / max(1, n)) * (1 << 30)))) if n > sample else rows
    picked = picked.limit(sample).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r.v), []).append(r.v)
    return {d: Codes(np.unique(np.array(v, float), axis=0), k, share=len(picked) / n) for d, v in by.items()}


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query, score the Euclidean distance."""
    models = learn(vectors, k, id_col, vec_col)
    return search(vectors, every, k, kernel(models), largest=False, score_type="double", id_col=id_col, vec_col=vec_col, nonzero=True)
