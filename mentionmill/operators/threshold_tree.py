"""Cluster metrics at every threshold, from a spanning forest and its merges.

Clusters at a threshold are the components of the pairs that score at least it.
As the threshold falls they only merge, and the merges are those of the edges of
a maximum spanning forest: every other pair joins what is joined already.  So a
table of any number of thresholds needs one forest, and the inputs of MUC,
B-cubed and CEAF-e are kept up to date merge by merge.

Mentions that can meet, through a pair or a gold chain, form a unit; all three
metrics are sums over units.  A task streams its units one after another.  A
merge costs the smaller of the two clusters' gold chains for MUC and B-cubed,
and for CEAF-e the chains of the merged cluster and a search for an augmenting
path in a matching that is kept from merge to merge (prices are never started
anew).  Units give changes by score; running sums over all scores are dealt by
ranges.  Pairs of one score are united at once, so their order does not matter.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import Scratch
from .cluster_metrics import _prf
from .filters import numbered, running_sums
from .graph import connected_components, heaviest, spanning_forest

#: What a merge changes.
CHANGES = ["muc_num", "resp_links", "b3_rnum", "b3_pnum", "ceafe_num", "resp_chains"]


class Matching:
    """A matching of clusters and chains of the largest total of 2 n / (chain's size + cluster's size), kept while clusters merge.

    Vertices are numbers, chains negative ones.  ``price`` of two ends is never
    below their weight, is equal to it where they are matched, and is 0 for a
    vertex left alone; that makes the matching the best one.
    """

    def __init__(self):
        self.links: dict[int, dict[int, int]] = {}  # vertex: {vertex of the other side: common mentions}
        self.size: dict[int, int] = {}
        self.price: dict[int, float] = {}
        self.mate: dict[int, int] = {}
        self.total = 0.0

    def weight(self, x: int, y: int) -> float:
        return 2 * self.links[x][y] / (self.size[x] + self.size[y])

    def add(self, x: int, size: int, links: dict[int, int]) -> None:
        """A cluster that is not there, with its chains (which are)."""
        self.size[x], self.links[x] = size, links
        for y, n in links.items():
            self.links[y][x] = n
        self.price[x] = max([0.0, *(self.weight(x, y) - self.price[y] for y in links)])

    def part(self, x: int) -> int | None:
        y = self.mate.pop(x, None)
        if y is not None:
            del self.mate[y]
            self.total -= self.weight(x, y)
        return y

    def unite(self, x: int, y: int) -> None:
        """Cluster y becomes a part of cluster x."""
        free = [v for v in (self.part(x), self.part(y)) if v is not None]
        if len(self.links[x]) < len(self.links[y]):
            self.links[x], self.links[y] = self.links[y], self.links[x]
            for v, own, other in [(v, x, y) for v in self.links[x]]:
                self.links[v].pop(other, None)
        gone = self.links.pop(y)
        links = self.links[x]
        for v, n in gone.items():
            self.links[v].pop(y, None)
            links[v] = links.get(v, 0) + n
        self.size[x] += self.size.pop(y)
        self.price.pop(y)
        for v, n in links.items():
            self.links[v][x] = n
        self.price[x] = max([0.0, *(self.weight(x, v) - self.price[v] for v in links)])
        for v in free:  # the old mate stays where it is still the best
            own = self.weight(x, v)
            if x not in self.mate and own - self.price[v] >= self.price[x] - 1e-15:
                self.mate[x], self.mate[v] = v, x
                self.price[x] = own - self.price[v]
                self.total += own
        for v in (*free, x):
            self.settle(v)

    def settle(self, start: int) -> None:
        """Match a vertex that is alone at a price above 0, or let it, or another one of its side, go at 0: the cheapest way."""
        price = self.price
        if start in self.mate or price[start] <= 0:
            return
        near: dict[int, float] = {}
        prev: dict[int, int] = {}
        done: dict[int, float] = {}
        side, heap = {start: 0.0}, []
        end, limit = start, price[start]
        x, base = start, 0.0
        while True:
            for y in self.links[x]:
                step = base + max(0.0, price[x] + price[y] - self.weight(x, y))
                if y not in done and step < limit and step < near.get(y, limit):
                    near[y], prev[y] = step, x
                    heapq.heappush(heap, (step, y))
            while heap and (heap[0][1] in done or heap[0][0] > near[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= limit:
                break
            base, y = heapq.heappop(heap)
            done[y] = base
            x = self.mate.get(y)
            if x is None:
                end, limit = y, base
                break
            side[x] = base
            if base + price[x] < limit:
                end, limit = x, base + price[x]
        for v, d in side.items():
            price[v] = max(0.0, price[v] - (limit - d))
        for v, d in done.items():
            price[v] += max(0.0, limit - d)
        if end == start:
            return
        if end in side:  # it gives up its mate
            y = self.mate[end]
            self.part(end)
        else:
            y = end
        while True:
            x = prev[y]
            held = self.mate.get(x)
            if held is not None:
                self.part(x)
            self.mate[x], self.mate[y] = y, x
            self.total += self.weight(x, y)
            if x == start:
                return
            y = held


def unit_changes(mentions: list[tuple[int, int, int]], edges: list[tuple[int, int, float]]):
    """(score, change of each of ``CHANGES``) of one unit by falling score; the first has no score and is the state of all mentions alone.

    ``mentions``: (mention, chain from 1, size of the chain).  ``edges``: (mention,
    mention, score) of a forest, by falling score.
    """
    m, root, own, square = Matching(), {}, {}, {}
    for i, c, size in mentions:
        m.size[-c] = size
        m.links.setdefault(-c, {})
        m.price.setdefault(-c, 0.0)
        own.setdefault(i, {})[-c] = 1
    for u, v, _ in edges:
        for i in (u, v):
            own.setdefault(i, {})
    for i, chains in own.items():
        square[i] = sum(n * n for n in chains.values())
        m.add(i, 1, chains)
        m.settle(i)
    yield (None, 0.0, 0.0, sum(1 / s for _, _, s in mentions), float(len(mentions)), m.total, 0.0)

    def find(i: int) -> int:
        top = i
        while (up := root.get(top, top)) != top:
            top = up
        while i != top:
            root[i], i = top, root.get(i, i)
        return top

    for score, some in groupby(edges, key=lambda e: e[2]):
        muc = links = recall = precision = 0.0
        before = m.total
        for u, v, _ in some:
            x, y = find(u), find(v)
            if x == y:
                continue
            if m.size[x] < m.size[y]:
                x, y = y, x
            few, many = sorted((m.links[x], m.links[y]), key=len)
            common = [(c, n * many[c]) for c, n in few.items() if c in many]
            muc += len(common)
            links += 1
            recall += sum(2 * n / m.size[c] for c, n in common)
            a, b = m.size[x], m.size[y]
            total = square[x] + square.pop(y) + 2 * sum(n for _, n in common)
            precision += total / (a + b) - square[x] / a - (total - square[x] - 2 * sum(n for _, n in common)) / b
            square[x] = total
            root[y] = x
            m.unite(x, y)
        yield (score, muc, links, recall, precision, m.total - before, -links)


def _streamed(batches):
    """Units of sorted rows (unit, kind, u, v, chain, score), one after another."""
    schema = pa.schema([("score", pa.float64()), *[(c, pa.float64()) for c in CHANGES]])

    def changed(mentions, edges):
        numbers: dict[str, int] = {}
        known = [(i, numbers.setdefault(c, len(numbers) + 1), size) for i, size, c in mentions]
        return pa.record_batch([pa.array(list(x), pa.float64()) for x in zip(*unit_changes(known, edges))], schema=schema)

    unit, mentions, edges = None, [], []
    for batch in batches:
        for own, is_edge, u, v, chain, score in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if own != unit and unit is not None:
                yield changed(mentions, edges)
                mentions, edges = [], []
            unit = own
            if is_edge:
                edges.append((u, v, score))
            else:
                mentions.append((u, v, chain))
    if unit is not None:
        yield changed(mentions, edges)


def _forest(u: np.ndarray, v: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a maximum spanning forest of n nodes; on a matrix, where the edges fill it."""
    if n * n > 16 * len(u):
        return heaviest(u, v, score)
    weight, place = np.full((n, n), -np.inf), np.full((n, n), -1, np.int32)
    weight[u, v] = weight[v, u] = score
    if (weight[u, v] != score).any():  # a pair with several scores
        return heaviest(u, v, score)
    place[u, v] = place[v, u] = np.arange(len(u), dtype=np.int32)
    np.fill_diagonal(weight, -np.inf)
    best, near, out = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    kept = []
    for _ in range(n):
        x = int(best.argmax())
        if best[x] == -np.inf:
            x = int(out.argmin())  # the first node of a component
        else:
            kept.append(place[near[x], x])
        out[x] = True
        closer = (weight[x] > best) & ~out
        near[closer], best[closer] = x, weight[x, closer]
        best[x] = -np.inf
    return np.array(kept, np.int64)


def thinned(pairs: pa.Table, a: str, b: str, score: str, step: float) -> pa.Table:
    """Those of a block's pairs that decide ``cluster_metrics_by_threshold`` of all of them, their scores rounded to multiples of ``step``.

    Clusters at every threshold come from a maximum spanning forest, which is one of the
    rounded scores too, as rounding keeps the order.  The smallest and the largest score in
    each half step hold every rounded score.  Mentions that have no score stay in one pair.
    """
    if not len(pairs):
        return pairs
    n = len(pairs)
    ends = pa.concat_arrays([pairs[c].combine_chunks() for c in (a, b)]).dictionary_encode()
    node = ends.indices.to_numpy().astype(np.int64)
    value = pairs[score].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    some = np.flatnonzero(~np.isnan(value))
    u, v, held = node[:n][some], node[n:][some], value[some]
    rows = [some[_forest(u, v, held, len(ends.dictionary))]]
    order = np.argsort(held, kind="stable")
    cell = np.floor(held[order] / (step / 2))
    change = np.flatnonzero(np.diff(cell))
    if len(order):
        rows += [some[order[np.append(0, change + 1)]], some[order[np.append(change, len(order) - 1)]]]
    seen = np.zeros(len(ends.dictionary), bool)
    for r in rows:
        seen[node[r]] = seen[node[n + r]] = True
    if not seen.all():
        names, first = np.unique(node, return_index=True)
        rows.append(first[~seen[names]] % n)
    return pairs.take(pa.array(np.unique(np.concatenate(rows))))


def cluster_metrics_by_threshold(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """``threshold, muc_f, b3_f, ceafe_f, conll_f`` for every distinct score of ``scored`` as threshold.

    ``scored(block, a, b, score)``, ``gold(block, mention, chain)``.  A cluster
    holds the mentions that are linked by pairs of at least the threshold; all
    mentions of ``scored`` are in one.  Numerators and denominators are summed
    over blocks.  Null scores link nothing and are no thresholds; NaN counts as
    null.  Repeated pairs, in either order, and repeated gold rows count once.
    """
    scratch = Scratch(scored.sparkSession, "thresholds")
    scored = scored.select("block", "a", "b", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"))
    nodes = numbered(scored.select("block", F.explode(F.array("a", "b")).alias("mention")).distinct(), ["block", "mention"], "id")
    nodes = scratch.table(nodes, "nodes")
    end = lambda of, name: nodes.select("block", F.col("mention").alias(of), F.col("id").alias(name))
    edges = scored.where("score is not null and a <> b").join(end("a", "u"), ["block", "a"]).join(end("b", "v"), ["block", "b"])
    forest = scratch.table(spanning_forest(edges.select("u", "v", "score")), "forest")
    key = gold.select("block", "mention", "chain").distinct()
    sizes = key.groupBy("block", "chain").agg(F.count(F.lit(1)).alias("size"))
    found = key.join(nodes, ["block", "mention"]).join(sizes, ["block", "chain"]).select("block", "id", F.col("chain").cast("string").alias("chain"), "size")
    found = scratch.table(found, "found")
    stars = found.join(found.groupBy("block", "chain").agg(F.min("id").alias("low")), ["block", "chain"]).where("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst"))
    units = connected_components(forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(stars))
    of = lambda rows, by: rows.join(units.withColumnRenamed("node", by), by, "left").withColumn("unit", F.coalesce("component", by))
    none = lambda kind: F.lit(None).cast(kind)
    rows = of(found, "id").select("unit", F.lit(False).alias("is_edge"), F.col("id").alias("u"), F.col("size").alias("v"), "chain", none("double").alias("score"))
    rows = rows.unionByName(of(forest, "u").select("unit", F.lit(True).alias("is_edge"), "u", "v", none("string").alias("chain"), "score"))
    tasks = 4 * int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "unit").sortWithinPartitions("unit", "is_edge", F.col("score").desc(), "u", "v")
    changes = rows.mapInArrow(_streamed, "score double, " + ", ".join(f"{c} double" for c in CHANGES))
    per = scratch.table(changes.groupBy("score").agg(*[F.sum(c).alias(c) for c in CHANGES]), "changes", narrow=True)
    scores = scored.where("score is not null").select("score").distinct()
    steps = scores.join(per, "score", "left").fillna(0.0, CHANGES)
    run = running_sums(steps, F.col("score").desc(), CHANGES)
    alone = per.where("score is null").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_0") for c in CHANGES])
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("key_mentions"), F.count(F.lit(1)).alias("key_chains")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("mentions")))
    c = F.col
    at = run.crossJoin(alone).crossJoin(whole)  # each one row
    at = at.select("score", "key_mentions", "key_chains", "mentions", *[(c(x) + c(f"{x}_0")).alias(x) for x in CHANGES])
    chains, key_links = c("mentions") + c("resp_chains"), c("key_mentions") - c("key_chains")
    got = at.select(
        c("score").alias("threshold"), *_prf("muc", c("muc_num"), key_links, c("muc_num"), c("resp_links")),
        *_prf("b3", c("b3_rnum"), c("key_mentions"), c("b3_pnum"), c("mentions")), *_prf("ceafe", c("ceafe_num"), c("key_chains"), c("ceafe_num"), chains),
    )
    return got.select("threshold", "muc_f", "b3_f", "ceafe_f", ((c("muc_f") + c("b3_f") + c("ceafe_f")) / 3).alias("conll_f"))


def best_cluster_threshold(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """The threshold with the largest CoNLL mean, to twelve places; the smallest one among equals."""
    rows = cluster_metrics_by_threshold(scored, gold)
    place = F.struct(F.round("conll_f", 12), -F.col("threshold"))
    return rows.agg(F.max_by("threshold", place).alias("threshold"), F.max_by("conll_f", place).alias("conll_f")).where("threshold is not null")
