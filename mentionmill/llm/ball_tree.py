"""Exact top-k by inner product: ball-tree branch and bound.

Components are turned into ``floor(scale * x)``; scores are exact integers.
Each shard has a ball tree.  A query walks it best first: nodes are ordered by
the upper bound  q.c + |q| r  of the inner product with anything in the ball,
and the walk ends when the best open bound is below the current kth score,
which starts from the bound shared by the query's home shard.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from .vector_search import search

LEAF, AT_ONCE = 128, 1024
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class BallTree:
    """Nodes as arrays; children of node i are ``left[i]`` and ``left[i] + 1`` (0: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        center, radius, self.left, self.span = [], [], [0], [(0, len(x))]
        i = 0
        while i < len(self.span):
            a, b = self.span[i]
            p = x[self.order[a:b]]
            c = p.mean(0)
            far = ((p - c) ** 2).sum(1)
            center.append(c)
            radius.append(np.sqrt(far.max()))
            if b - a > leaf and far.max() > 0:
                one = p[far.argmax()]
                two = p[((p - one) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(p @ (two - one), half)]
                self.left[i] = len(self.span)
                self.span += [(a, a + half), (a + half, b)]
                self.left += [0, 0]
            i += 1
        self.center, self.radius = np.array(center), np.array(radius)


def _quantised(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def kernel(scale: int, leaf: int = LEAF):
    def run(uids, x, queries, bounds, k):
        with np.errstate(over="ignore", invalid="ignore"):
            x, queries = _quantised(x, scale), _quantised(queries, scale)
            exact = float(np.abs(x).max()) * float(np.abs(queries).max()) * x.shape[1] < _EXACT
        if not exact:
            return _wide(uids, x, queries, bounds, k)
        tree = BallTree(x, leaf)
        uids, x = uids[tree.order], x[tree.order]
        norm = np.sqrt((queries**2).sum(1))
        slackness = 1e-9 * (norm * (np.abs(tree.center).max() + tree.radius.max()) + 1)
        out = []
        for n, (q, bound) in enumerate(zip(queries, bounds)):
            if n % AT_ONCE == 0:  # bounds of all nodes for some queries at a time
                some = slice(n, n + AT_ONCE)
                upper = queries[some] @ tree.center.T + norm[some, None] * tree.radius + slackness[some, None]
            up = upper[n % AT_ONCE]
            low = -np.inf if bound is None else bound
            ids, scores = np.empty(0, np.int64), np.empty(0)
            heap = [(-up[0], 0)]
            while heap and -heap[0][0] >= low:
                _, i = heapq.heappop(heap)
                if c := tree.left[i]:
                    for j in (c, c + 1):
                        if up[j] >= low:
                            heapq.heappush(heap, (-up[j], j))
                    continue
                a, b = tree.span[i]
                s = x[a:b] @ q
                hit = s >= low
                if hit.any():
                    ids, scores = np.concatenate([ids, uids[a:b][hit]]), np.concatenate([scores, s[hit]])
                    if len(ids) > k:
                        top = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[top], scores[top]
                    if len(ids) == k:
                        low = max(low, scores.min())
            top = np.lexsort((ids, -scores))
            out.append((ids[top], scores[top].astype(np.int64)))
        return out

    return run


def _wide(uids, x, queries, bounds, k):
    """Components too large for exact doubles: Python integers, ranked as they are; only what is returned is kept within 64 bits.

    Scores that leave a task have 64 bits, so those beyond it meet as equals where
    several shards are merged.
    """
    big = lambda m: [[int(v) if np.isfinite(v) else (_LONG if v > 0 else -_LONG) for v in r] for r in m.tolist()]
    kept = lambda v: max(-_LONG, min(_LONG, v))
    x, out = big(x), []
    for q, bound in zip(big(queries), bounds):
        s = [sum(a * b for a, b in zip(q, r)) for r in x]
        top = sorted((i for i in range(len(s)) if bound is None or kept(s[i]) >= bound), key=lambda i: (-s[i], uids[i]))[:k]
        out.append((np.array([uids[i] for i in top], np.int64), np.array([kept(s[i]) for i in top], np.int64)))
    return out


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, **names) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest integer inner products."""
    return search(vectors, every, k, kernel(scale), largest=True, score_type="long", **names)
