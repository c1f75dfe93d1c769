"""Chains that grow with a stream of predictions.

Predictions arrive in any order and any batches.  A block's union-find lives in
the state store, a row for each mention; a batch reads and writes only the
mentions that it touches and those above them.  A chain goes by its smallest
mention, as in a batch, so the order of arrival does not matter.  Before that the
tasks that read a batch contract its predictions of each block and time to a row
or so for each mention, so what is shuffled and followed one by one is not pairs.

Each batch gives what changed: a row for every new mention, and one for every
chain that became part of another (its old name with the new one).  Such rows
are links inside chains, so ``settled`` gives the chains of all that has
arrived.  When the watermark passes a block's latest prediction by ``quiet``,
its timer gives every mention with its chain, marked ``final``, and the block's
state is dropped.  Later predictions of such a block are late and left out by
Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import HELD, connected_components, lowest

#: Rows of an output batch.
ROWS = 10_000


class Chains(StatefulProcessor):
    """Union-find of one block; ``block, mention, cluster, final`` out."""

    def __init__(self, threshold: float, quiet_ms: int, kind: str):
        self.threshold, self.quiet, self.kind = threshold, quiet_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.above = handle.getMapState("above", f"mention {self.kind}", f"above {self.kind}")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict = {}  # what this batch has read
        new: dict = {}  # what it has to write
        out, latest = [], None

        def above(m):
            if m not in held:
                held[m] = self.above.getValue((m,))[0] if self.above.containsKey((m,)) else None
                if held[m] is None:
                    held[m] = new[m] = m
                    out.append((m, m))
            return held[m]

        def find(m):
            top = m
            while (up := above(top)) != top:
                top = up
            while m != top:
                nxt = held[m]
                if nxt != top:
                    held[m] = new[m] = top
                m = nxt
            return top

        for batch in rows:
            at = batch["at"].max()
            latest = at if latest is None or at > latest else latest
            for a, b, score in zip(batch["a"].tolist(), batch["b"].tolist(), batch["score"].tolist()):
                x, y = find(a), find(b)
                if score is not None and score >= self.threshold and x != y:
                    low, high = (x, y) if x < y else (y, x)
                    held[high] = new[high] = low
                    out.append((high, low))
        for m, up in new.items():
            self.above.updateValue((m,), (up,))
        due = int(latest.timestamp() * 1000) + self.quiet
        old = self.due.get() if self.due.exists() else None
        if old is None or due > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from self._frames(key, out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        up = {m[0]: a[0] for m, a in self.above.iterator()}

        def top(m):
            while up[m] != m:
                m = up[m]
            return m

        yield from self._frames(key, ((m, top(m)) for m in up), True)
        self.above.clear()
        self.due.clear()

    def _frames(self, key, rows, final: bool) -> Iterator[pd.DataFrame]:
        rows = list(rows)
        for lo in range(0, len(rows), ROWS):
            some = rows[lo : lo + ROWS]
            yield pd.DataFrame({"block": key[0], "mention": [m for m, _ in some], "cluster": [c for _, c in some], "final": final})


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state of this kind needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def _contracted(threshold: float):
    """Predictions ``block, a, b, score, at`` of a task, ``HELD`` at a time, as fewer with the same chains.

    Those of one block and time become stars of links that reach the threshold, and
    a row for each mention without one, so what is late stays late.  Those without
    both ends become one, of their latest time.
    """

    def stars(t: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = pc.and_(t["a"].is_valid(), t["b"].is_valid())
        if not pc.all(whole, min_count=0).as_py():
            at = pa.array([pc.max(t.filter(pc.invert(whole))["at"]).as_py()], t.schema.field("at").type)
            yield pa.record_batch([at if f.name == "at" else pa.array([-np.inf]) if f.name == "score" else pa.nulls(1, f.type) for f in t.schema], schema=t.schema)
            t = t.filter(whole)
        if not len(t):
            return
        coded = lambda c: pa.chunked_array(c, c[0].type).combine_chunks().dictionary_encode("encode")
        block, at, ends = coded(t["block"].chunks), coded(t["at"].chunks), coded([*t["a"].chunks, *t["b"].chunks])
        times, names = len(at.dictionary), len(ends.dictionary)
        place = (block.indices.to_numpy().astype(np.int64) * times + at.indices.to_numpy()) * names
        u, v = np.split(ends.indices.to_numpy() + np.tile(place, 2), 2)
        tied = t["score"].to_numpy() >= threshold
        node, low = lowest(u[tied], v[tied])
        far = node != low
        node, low = node[far], low[far]
        alone = np.setdiff1d(np.concatenate([u, v]), np.concatenate([node, low]))
        one, two = np.concatenate([node, alone]), np.concatenate([low, alone])
        score = np.where(np.arange(len(one)) < len(node), float(threshold), -np.inf)
        take = lambda of, k: of.dictionary.take(pa.array(k))
        yield pa.record_batch([take(block, one // names // times), take(ends, one % names), take(ends, two % names), pa.array(score), take(at, one // names % times)], schema=t.schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= HELD:
                yield from stars(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from stars(pa.Table.from_batches(held))

    return run


def growing_chains(scored: DataFrame, threshold: float, late: str = "1 hour", quiet_ms: int = 3_600_000) -> DataFrame:
    """``block, mention, cluster, final`` of a stream ``block, a, b, score, at`` (append mode).

    Start it inside ``state_in_rocksdb``.  A score of null or NaN links nothing; rows
    without both ends only move the watermark.  A block is one task of each batch, as
    its links follow each other; its work there is the mentions that the batch touches.
    """
    kinds = dict(scored.dtypes)
    rows = scored.select("block", "a", "b", F.nanvl(F.col("score").cast("double"), F.lit(-float("inf"))).alias("score"), "at").fillna(-float("inf"), ["score"])
    rows = rows.mapInArrow(_contracted(threshold), rows.schema).withWatermark("at", late)
    # it names the time, so that it is not pushed below the watermark
    rows = rows.where(F.when(F.col("at").isNotNull(), F.col("a").isNotNull() & F.col("b").isNotNull()))
    return rows.groupBy("block").transformWithStateInPandas(
        statefulProcessor=Chains(threshold, quiet_ms, kinds["a"]), outputStructType=f"block {kinds['block']}, mention {kinds['a']}, cluster {kinds['a']}, final boolean",
        outputMode="append", timeMode="eventtime",
    )


def settled(changes: DataFrame) -> DataFrame:
    """``block, mention, cluster`` of all that has arrived, from a table of what ``growing_chains`` gave."""
    node = lambda c: F.struct("block", F.col(c).alias("m"))
    links = changes.select(node("mention").alias("src"), node("cluster").alias("dst"))
    found = connected_components(links)
    return found.select("node.block", F.col("node.m").alias("mention"), F.col("component.m").alias("cluster"))
