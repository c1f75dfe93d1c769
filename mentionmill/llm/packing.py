"""Best-fit packing of token pieces, as hierarchical residual packing.

1. Documents are encoded in Arrow batches; those longer than the capacity are
   cut.  Only (document, piece, start, length, crc) leaves this step.
2. Each partition packs its own pieces best-fit, longest first, and emits the
   bins that are nearly full.  The others become items of the next round.
3. Rounds: partitions are merged by ``FAN``; underfull bins are packed into
   each other as items, best-fit, and nearly full ones are emitted.  A merge
   task carries at most ``CARRY`` bins on, the emptiest; fuller ones are emitted
   as they are, so no task grows with the input.  The last round has one task.
A bin holds at most ``capacity`` pieces, so a row is bounded.

Null or empty texts have one piece, the end id.  Rows with a null or repeated
id are packed like others.  An empty table gives an empty result.  Only the two
named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from ..storage import Scratch
from .texthash import blocks, small_batches
from .tokenmemo import word_memo

PART_ROWS, FAN, CARRY, NEARLY = 50_000, 16, 20_000, 8
_BIN = "bin long, fill int, docs array<long>, pieces array<int>, starts array<long>, lengths array<int>, crcs array<long>, places array<int>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin, packed best-fit in decreasing size (ties: first come).

    Open bins are kept by residual; a bit set of the residuals in use gives the
    smallest that an item fits in.
    """
    order = np.argsort(-np.asarray(sizes), kind="stable").tolist()
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, out = 0, []
    for i in order:
        size = int(sizes[i])
        above = used >> size
        if above:
            rest = size + ((above & -above).bit_length() - 1)
            b = open_at[rest].pop()
            if not open_at[rest]:
                used &= ~(1 << rest)
            out[b].append(i)
        else:
            b, rest = len(out), capacity
            out.append([i])
        rest -= size
        if rest:
            open_at[rest].append(b)
            used |= 1 << rest
    return out


def piece_rows(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches):
        memo = word_memo(tokenizer)
        for batch in batches:
            for own, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, off = memo.encode(texts, end_id)
                ids = ids.astype("<u4", copy=False)
                rows = []
                for d, a, b in zip(own, off[:-1].tolist(), off[1:].tolist()):
                    for k, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        rows.append((d, k, s - a, e - s, zlib.crc32(ids[s:e].data)))
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return base.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long")


def _first(capacity: int):
    """Local packing of one group of pieces."""

    def run(t: pa.Table) -> pa.Table:
        size = t.column("length").to_numpy()
        bins = best_fit(size, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        cols = [t.column(c).to_numpy(zero_copy_only=False) if c != "doc_id" else None for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        off = np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(off, (t.column("doc_id").combine_chunks() if c is None else pa.array(c)).take(pa.array(order)))
            for c in cols
        ]
        fill = np.add.reduceat(size[order], off[:-1]).astype(np.int32)
        part = t.column("part")[0].as_py()
        places = pa.ListArray.from_arrays(off, pa.array(_places(size[order], off)))
        return pa.table([pa.array(_numbers(part, len(bins))), pa.array(fill), *lists, places], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("bin", pa.int64()), ("fill", pa.int32()), ("docs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("crcs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
])


def _places(lengths: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each piece begins in its bin; bin i holds the pieces off[i]..off[i+1]-1."""
    before = np.cumsum(lengths, dtype=np.int64) - lengths
    return (before - np.repeat(before[off[:-1]], np.diff(off))).astype(np.int32)


def _numbers(part: int, n: int) -> np.ndarray:
    return (np.int64(part) << np.int64(32)) + np.arange(n, dtype=np.int64)


def _merge(capacity: int):
    """One merge task: underfull bins packed into each other; a merged bin keeps its largest member's number."""

    def run(t: pa.Table) -> pa.Table:
        fill = t.column("fill").to_numpy()
        bins = best_fit(fill, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])])
        moved = t.select(["docs", "pieces", "starts", "lengths", "crcs"]).combine_chunks().take(pa.array(order))
        held = pa.compute.list_value_length(moved.column("docs").combine_chunks()).to_numpy()
        off = np.concatenate([[0], np.cumsum(held)])[first].astype(np.int32)
        flat = {c: moved.column(c).combine_chunks().flatten() for c in moved.column_names}
        lists = [pa.ListArray.from_arrays(off, flat[c]) for c in moved.column_names]
        places = pa.ListArray.from_arrays(off, pa.array(_places(flat["lengths"].to_numpy(), off)))
        number = t.column("bin").to_numpy()[order[first[:-1]]]
        total = np.add.reduceat(fill[order], first[:-1]).astype(np.int32)
        return pa.table([pa.array(number), pa.array(total), *lists, places], schema=_SCHEMA)

    return run


def pack(pieces: DataFrame, capacity: int = 4096, nearly: int = NEARLY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``piece_rows``."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    held = scratch.table(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces", narrow=True)
    n = held.count()
    parts = max(1, math.ceil(n / PART_ROWS))
    # dealt by the written rows' own numbers, so a repeated task packs the same pieces and repeated rows spread
    dealt = held.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    now = scratch.table(dealt.groupBy("part").applyInArrow(_first(capacity), _BIN), "bins0")
    done, k = [], 0
    while True:
        full = F.col("fill") >= capacity - nearly
        if parts == 1 and k:
            done.append(now)
            break
        parts = max(1, math.ceil(parts / FAN))
        rest = now.where(~full).withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(parts)).cast("int"))
        # carry the emptiest bins; the fill below which all merge tasks together hold few enough
        least, seen = capacity, 0
        for r in sorted(rest.groupBy("fill").count().collect()):  # at most ``capacity`` rows
            seen += r["count"]
            if seen > CARRY * parts:
                least = r.fill
                break
        carried = rest.where(F.col("fill") < least)
        done.append(now.where(full | (F.col("fill") >= least)))
        now = scratch.table(carried.groupBy("part").applyInArrow(_merge(capacity), _BIN), f"bins{k + 1}")
        k += 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    rows = bins.select("bin", F.explode(F.arrays_zip("docs", "pieces", "starts", "lengths", "crcs", F.col("places").alias("at"))).alias("x"))
    return rows.select(
        F.col("x.docs").alias("doc_id"), F.col("x.pieces").alias("piece"), F.col("x.starts").alias("start"),
        F.col("x.lengths").cast("long").alias("length"), F.col("x.crcs").alias("ids_crc32"),
        F.col("bin").alias("sequence_id"), F.col("x.at").cast("long").alias("offset"),
    )
