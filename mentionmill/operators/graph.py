"""Graph operators on edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from ..storage import Scratch

#: Edges that a task contracts at once, and that one task may hold in the end.
HELD = 1 << 20


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of an edge list."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return nodes, nodes[root]


def _contracted(batches):
    """Edges as stars, one for each component of each ``HELD`` edges of a task."""
    held, size = [], 0

    def stars():
        t = pa.Table.from_batches(held)
        u, v = (t.column(i).to_numpy() for i in (0, 1))
        node, low = lowest(u, v)
        keep = node != low
        return pa.record_batch([pa.array(node[keep], t.schema.field(0).type), pa.array(low[keep], t.schema.field(1).type)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table.

    Returns ``node, component`` for every node that occurs in an edge;
    ``component`` is the smallest node of the component.  Tasks first contract
    their own edges to stars.  If at most ``HELD`` edges are left, one task ends
    the work.  Else two star contractions alternate: link larger neighbours, then
    all lower neighbours, to the local minimum.  Each is a map-side combined
    ``min``, written to the shared folder, and a join of written tables, which
    AQE splits when a hub is hot.
    Lineage stays short and a lost executor costs one step.  Null ends and
    self loops are accepted; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cc")
    a, b = F.col(src), F.col(dst)
    raw = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    loops = raw.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    first = raw.where("u <> v")
    plain = first.schema["u"].dataType.simpleString() in ("int", "bigint", "string")  # what numpy sorts as Spark does
    if plain:
        first = first.mapInArrow(_contracted, first.schema)

    def written(df: DataFrame, name: str, narrow: bool = False) -> tuple[DataFrame, tuple]:
        """The written edges, and their count and checksum, observed while they are written."""
        seen = Observation()
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        out = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), name, narrow)
        return out, (seen.get["n"], seen.get["digest"])

    cur, state = written(first if plain else first.distinct(), "edges", plain)
    for k in range(max_rounds):
        if state[0] == 0:
            break
        if plain and state[0] <= HELD:
            cur = scratch.table(cur.coalesce(1).mapInArrow(_contracted, cur.schema), "stars")
            break
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.table(low, f"low{k}")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"large{k}")
        down = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"down{k}")
        small = (
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new, found = written(small, f"round{k}")
        scratch.drop(cur, low, large, down)
        cur = new
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("connected_components did not settle")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    known = stars.unionByName(roots)
    return known.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def heaviest(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the edges of the maximum spanning forest, by falling score; of equals the smaller ends come first."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), -score))
    a, b, root, kept = back[: len(u)].tolist(), back[len(u) :].tolist(), list(range(len(nodes))), []
    for i in order.tolist():
        x, y = a[i], b[i]
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            kept.append(i)
    return np.array(kept, np.int64)


def _forest_of_task(batches):
    """What a task's edges may add to the forest, ``HELD`` edges at a time: an edge that closes a circle of heavier ones is in no forest."""
    held, size, kept = [], 0, None

    def pruned():
        t = pa.Table.from_batches(held).combine_chunks()
        return t.take(pa.array(heaviest(*(t.column(c).to_numpy() for c in ("cu", "cv", "score"))))).combine_chunks()

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            kept = pruned()
            held, size = (kept.to_batches(), len(kept)) if len(kept) <= HELD // 2 else ([], 0)
            if not size:
                yield from kept.to_batches()
    if held:
        yield from pruned().to_batches()


def spanning_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maximum spanning forest ``u, v, score`` of edges of whole-number ends and double scores.

    Tasks drop the edges that close circles among their own.  While more than
    ``HELD`` are left, rounds follow: every component picks its heaviest edge to
    another one (a map-side combined maximum), the picked edges join the forest,
    their components become one, and edges inside them go.  A round halves the
    components at least.  In the end one task takes what is left.  Which of equal
    edges is taken changes no component at any score.
    Null ends or scores and self loops are left out; repeated edges count once.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "forest")
    u, v = F.least("u", "v").cast("long"), F.greatest("u", "v").cast("long")
    first = edges.select(u.alias("u"), v.alias("v"), F.col("score").cast("double").alias("score")).where("u is not null and v is not null and u <> v and score is not null")
    cur = first.select(F.col("u").alias("cu"), F.col("v").alias("cv"), "u", "v", "score")
    ddl, done = "cu long, cv long, u long, v long, score double", []

    def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        out = scratch.table(df.mapInArrow(_forest_of_task, ddl).observe(seen, F.count(F.lit(1)).alias("n")), name, narrow=True)
        return out, seen.get["n"]

    cur, n = written(cur, "edges")
    for k in range(max_rounds):
        if n <= HELD:
            done.append(cur.coalesce(1).mapInArrow(_forest_of_task, ddl).select("u", "v", "score"))
            break
        ways = cur.select(F.col("cu").alias("c"), "cu", "cv", "u", "v", "score").unionByName(cur.select(F.col("cv").alias("c"), "cu", "cv", "u", "v", "score"))
        place = F.struct("score", (-F.least("cu", "cv")).alias("x"), (-F.greatest("cu", "cv")).alias("y"), (-F.col("u")).alias("p"), (-F.col("v")).alias("q"))
        picked = ways.groupBy("c").agg(F.max_by(F.struct("cu", "cv", "u", "v", "score"), place).alias("e")).select("e.*").distinct()
        picked = scratch.table(picked, f"picked{k}", narrow=True)
        done.append(picked.select("u", "v", "score"))
        comp = connected_components(picked, "cu", "cv")
        ends = lambda name: comp.select(F.col("node").alias(name), F.col("component").alias(f"{name}_"))
        left = cur.join(ends("cu"), "cu", "left").join(ends("cv"), "cv", "left").select(F.coalesce("cu_", "cu").alias("cu"), F.coalesce("cv_", "cv").alias("cv"), "u", "v", "score")
        old, (cur, n) = cur, written(left.where("cu <> cv"), f"round{k}")
        scratch.drop(old)
    else:
        raise RuntimeError("spanning_forest did not settle")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
