"""N-gram Jaccard join with parity sketches.

Two texts link when ``100 * |A & B| >= pct * |A | B|`` over their distinct
word shingles.  Then |A ^ B| <= (|A| + |B|) * (100 - pct) / (100 + pct).

1. Every text becomes its set of 64-bit shingle hashes (Arrow batches, numpy);
   texts with the same set (128-bit digest and size) are one class from here on.
2. A linked text has at most ``(100 - pct) %`` shingles that no other text has.
   So the shingles of a fixed part of the hash space are counted over the whole
   table, packed by hash range, and classes with more unshared ones are settled.
   What a task sees twice itself is settled there, so a shingle reaches its
   range at most once for each block of a task, however many texts hold it.
3. The others are put in size bands.  A band's sets are hashed into m segments;
   k is the largest symmetric difference of a linked pair in the band.  A segment
   is a parity sketch: each shingle flips one of 2**20 bits.  One differing
   shingle changes one bit of one segment, so a linked pair agrees on at least
   m - k segments.  A segment's key is the xor of the hashes of its set bits,
   which is how the sketch is joined without being stored.  A set keeps its
   k + 1 strongest segments (most bits, then largest key): the strongest of the
   agreeing ones has m - k - 1 weaker segments below it in either set, so both
   keep it.  m is so large that the empty ones are among those left out.
4. Texts with an equal key meet through a star to the key's smallest class, so
   rows stay linear in the keys however many texts share one.  Components of
   these unverified stars are families; a linked pair never crosses families.
5. Families are dealt in blocks of bounded size, each set once.  In a block a
   dense parity sketch (popcount of xor <= |A ^ B|) discards pairs, the rest are
   verified on the exact sets unless already connected, and a spanning forest of
   the true links leaves the block.  Families of several blocks are then reduced
   to the texts of keys that still hold texts of different components, and dealt
   anew; what is left after ``TURNS`` such rounds is compared block by block.
6. Components of the forest are the result.

Nulls, empty texts: empty set, linked with nothing, a component of their own.
Rows with a null id: counted, never linked through the id; component_id is the
class's smallest id, or null.  Rows sharing an id are one document, linked by
any of its texts.  Columns of ``docs`` other than the two named are not read, so
their names cannot clash.

Shingles are compared as 64-bit hashes.  For a pair of sets of n shingles the
chance that any two different ones meet is under n * n / 2**64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..storage import Scratch
from .texthash import blocks, doc_words, mix, shingles, small_batches

_U = np.uint64
POSITIONS = 20  # bits of a position inside a segment
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 21
SKETCH_WORDS = 1 << 20  # of all dense sketches of a task
HELD, RANGE = 1 << 20, 1 << 21  # shingles of a task's block, and of a hash range
TURNS = 2


def slack(total: int | np.ndarray, pct: int):
    """Largest symmetric difference of a linked pair whose sizes sum to ``total``."""
    return total * (100 - pct) // (100 + pct)


def bands(pct: int, most: int = 1 << 40, ratio: float = 1.15) -> list[int]:
    """Lower ends of the size bands; the first is the smallest size that can link to another set."""
    lo = 1
    while slack(lo + lo * 100 // pct, pct) < 1:
        lo += 1
    out = [lo]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


def band_shape(lo: int, hi: int, pct: int) -> tuple[int, int]:
    """(segments m, largest difference k) of the band of sizes lo..hi-1."""
    k = slack(hi - 1 + (hi - 1) * 100 // pct, pct)
    return 49 + (k + 1) * 8 // 5, k


def segment_keys(sh: np.ndarray, band: int, m: int, k: int) -> np.ndarray:
    """Join keys of one set in one band: its k + 1 strongest segments."""
    seed = _U((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = mix(sh ^ seed)
    seg = (x >> _U(32)) * _U(m) >> _U(32)
    bit = (seg << _U(POSITIONS)) | (x & _U((1 << POSITIONS) - 1))
    bit, times = np.unique(bit, return_counts=True)
    bit = bit[(times & 1) == 1]
    seg = (bit >> _U(POSITIONS)).astype(np.int64)
    count = np.bincount(seg, minlength=m)
    key = mix(np.arange(m, dtype=_U) + seed)  # an empty segment's key
    if len(bit):
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        key[seg[first]] ^= np.bitwise_xor.reduceat(mix(bit ^ _U(0x5851F42D4C957F2D)), first)
    return key[np.lexsort((key, count))[m - k - 1 :]]


def sampled(sh: np.ndarray, pct: int) -> np.ndarray:
    """The shingles that are counted over the table: 2.5 (100 - pct) % of the hash space, to the next power of two below."""
    return sh[(sh & _U((1 << sample_bits(pct)) - 1)) == 0]


def sample_bits(pct: int) -> int:
    return max(0, math.ceil(math.log2(40 / max(1, 100 - pct))))


def _sets(rows, k: int):
    """(id, sorted distinct shingle hashes) of (id, text) Arrow batches."""
    for batch in rows:
        for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, off = doc_words(texts)
            for i, d in enumerate(ids):
                yield d, shingles(h[off[i] : off[i + 1]], k)


def _batches(gen, schema: pa.Schema, weigh, limit: int = 1 << 18):
    rows, size = [], 0
    for row in gen:
        rows.append(row)
        size += weigh(row)
        if size >= limit:
            yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)


def _digest(sh: np.ndarray) -> tuple[int, int]:
    a = mix(sh ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U)
    b = mix(sh * _U(0x9FB21C651E98DF25)).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _digests(k: int, pct: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "d1", "d2", "asked")])

    def run(rows):
        yield from _batches(((d, len(s), *_digest(s), len(sampled(s, pct))) for d, s in _sets(rows, k)), schema, lambda r: 8)

    return run


_SEEN = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("once", "owner", "more", "ids", "times"))])


def _packed(hashes: list[np.ndarray], owners: list[int], parts: int):
    """A block's sampled shingles by hash range: those of one text with its id, those of several; and what the latter settle."""
    h = np.concatenate(hashes)
    o = np.repeat(np.array(owners, np.int64), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    times = np.diff(np.append(first, len(h)))
    single = first[times == 1]
    many = h[first[times > 1]]
    edges = np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)
    edges = edges.astype(_U)
    a = np.concatenate([[0], np.searchsorted(h[single], edges), [len(single)]])
    b = np.concatenate([[0], np.searchsorted(many, edges), [len(many)]])
    one, own = h[single], o[single]
    rows = [
        (i, one[a[i] : a[i + 1]].tobytes(), own[a[i] : a[i + 1]].tobytes(), many[b[i] : b[i + 1]].tobytes(), b"", b"")
        for i in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
    ]
    ids, n = np.unique(o[np.repeat(times > 1, times)], return_counts=True)
    if len(ids):
        rows.append((int(h[0] % _U(parts)), b"", b"", b"", ids.tobytes(), n.astype(np.int64).tobytes()))
    return pa.record_batch([list(c) for c in zip(*rows)], schema=_SEEN)


def _seen(k: int, pct: int, parts: int):
    def run(rows):
        hashes, owners, size = [], [], 0
        for d, s in _sets(rows, k):
            s = sampled(s, pct)
            if d is None or not len(s):
                continue
            hashes.append(s)
            owners.append(d)
            size += len(s)
            if size >= HELD:
                yield _packed(hashes, owners, parts)
                hashes, owners, size = [], [], 0
        if hashes:
            yield _packed(hashes, owners, parts)

    return run


_SUMS = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("times", pa.binary())])


def _column(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _shared(parts: int):
    """How many shingles of each text other texts have, as far as a hash range tells, packed by id."""

    def run(t: pa.Table) -> pa.Table:
        one, own, ids = _column(t, "once", _U), _column(t, "owner", np.int64), _column(t, "ids", np.int64)
        _, back, count = np.unique(np.concatenate([one, _column(t, "more", _U)]), return_inverse=True, return_counts=True)
        own = own[count[back[: len(one)]] > 1]
        ids, times = _summed(np.concatenate([own, ids]), np.concatenate([np.ones(len(own), np.int64), _column(t, "times", np.int64)]))
        of = (mix(ids.view(_U)) % _U(parts)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        some, first = np.unique(of[order], return_index=True)
        rows = [(int(i), ids[x].tobytes(), times[x].tobytes()) for i, x in zip(some, np.split(order, first[1:]))] if len(some) else []
        return pa.table([list(c) for c in zip(*rows)] if rows else [[], [], []], schema=_SUMS)

    return run


def _summed(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, back = np.unique(ids, return_inverse=True)
    return ids, np.bincount(back, times, len(ids)).astype(np.int64)


def _totals(t: pa.Table) -> pa.Table:
    ids, times = _summed(_column(t, "ids", np.int64), _column(t, "times", np.int64))
    return pa.table({"doc_id": ids, "shared": times})


def _keyed(k: int, pct: int, may):
    """Sets and join keys of the texts whose ids ``may`` lets through."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("shs", pa.binary())])
    lows = np.array(bands(pct), np.int64)

    def keys(sh):
        n = len(sh)
        b = int(np.searchsorted(lows, n, "right")) - 1
        out = [segment_keys(sh, b, *band_shape(int(lows[b]), int(lows[b + 1]), pct))]
        # the larger partner of a set that lies in a lower band
        c = b - 1
        while c >= 0 and n * pct <= (int(lows[c + 1]) - 1) * 100:
            out.append(segment_keys(sh, c, *band_shape(int(lows[c]), int(lows[c + 1]), pct)))
            c -= 1
        return np.concatenate(out).view(np.int64)

    def some(rows):
        for batch in rows:
            ids = batch.column(0)
            ok = ids.is_valid() if may is None else pa.array(may.value(ids))
            if len(batch := batch.filter(ok)):
                yield batch

    def rows_of(rows):
        for d, s in _sets(some(rows), k):
            if len(s) >= lows[0]:
                yield d, len(s), *_digest(s), keys(s), s.tobytes()

    def run(rows):
        yield from _batches(rows_of(rows), schema, lambda r: 16 + len(r[4]) + len(r[5]) // 8)

    return run


def dense_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches of several sets, four bits for each element of the largest as far as memory goes."""
    words = max(1, min(-(-4 * max(map(len, sets)) // 64), SKETCH_WORDS // len(sets)))
    nbits = _U(64 * words)
    row = np.repeat(np.arange(len(sets), dtype=_U), [len(s) for s in sets])
    bit, times = np.unique(row * nbits + np.concatenate(sets) % nbits, return_counts=True)
    bit = bit[(times & 1) == 1]
    out = np.zeros(len(sets) * words, _U)
    if len(bit):
        word = (bit >> _U(6)).astype(np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(_U(1) << (bit & _U(63)), first)
    return out.reshape(len(sets), words)


def forest(ids: list[int], sets: list[np.ndarray], pct: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among some sets; with ``side``, of those between the two sides.

    Sets with an equal ``label`` are connected already.
    """
    n, out = len(ids), []
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    sketch, size = dense_sketches(sets), np.array([len(s) for s in sets])
    left = range(n) if side is None else np.flatnonzero(side == 0)
    right = None if side is None else np.flatnonzero(side == 1)
    for i in left:
        js = np.arange(i + 1, n) if right is None else right
        js = js[(label[js] != label[i]) & (size[js] * pct <= size[i] * 100) & (size[i] * pct <= size[js] * 100)]
        if not len(js):
            continue
        step = max(1, (1 << 16) // sketch.shape[1])
        ham = np.concatenate([np.bitwise_count(sketch[js[a : a + step]] ^ sketch[i]).sum(1, dtype=np.int64) for a in range(0, len(js), step)])
        most = slack(size[js] + size[i], pct)
        hit = np.flatnonzero(ham <= most)
        for j in js[hit[np.argsort(ham[hit], kind="stable")]]:
            if label[i] == label[j]:
                continue
            both = len(sets[i]) + len(sets[j])
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= pct * (both - common):
                label[label == label[j]] = label[i]
                out.append((ids[i], ids[int(j)]))
    return out


def _verify(pct: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, label = table.column("doc_id").to_pylist(), table.column("label").to_numpy()
        sets = [np.frombuffer(b, _U) for b in table.column("shs").to_pylist()]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        side = None if x == y else (np.array(table.column("own").to_pylist()) == y).astype(int)
        found = forest(ids, sets, pct, side, label) if len(ids) > 1 else []
        return pa.table({"src": [a for a, _ in found], "dst": [b for _, b in found]}, schema=schema)

    return run


class _May:
    """Tells which ids may be among some; at most ``MOST`` of them, in a bit set of 2**25 bits, three for each id."""

    BITS, MOST = 25, 1 << 22

    def __init__(self, ids: DataFrame):
        """``ids``: one long column without nulls.  At most 2**19 words of 64 bits reach the driver."""
        schema = pa.schema([("w", pa.int32()), ("bits", pa.int64())])

        def run(batches):
            for batch in batches:
                p = np.unique(np.concatenate(_May.places(batch.column(0).to_numpy())))
                first = np.flatnonzero(np.diff(p >> _U(6), prepend=_U(1 << 63)))
                if len(p):
                    bits = np.bitwise_or.reduceat(_U(1) << (p & _U(63)), first)
                    yield pa.record_batch([pa.array((p[first] >> _U(6)).astype(np.int32)), pa.array(bits.view(np.int64))], schema=schema)

        got = ids.mapInArrow(run, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
        self.words = np.zeros(1 << self.BITS - 6, _U)
        self.words[got.w.to_numpy()] = got.bits.to_numpy().view(_U)

    @staticmethod
    def places(ids: np.ndarray) -> list[np.ndarray]:
        x = ids.astype(np.int64).view(_U)
        return [mix(x + _U(c)) >> _U(64 - _May.BITS) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def __call__(self, ids: pa.Array) -> np.ndarray:
        ok = ids.is_valid().to_numpy(zero_copy_only=False)
        for p in self.places(ids.fill_null(0).to_numpy()):
            ok &= (self.words[p >> _U(6)] >> (p & _U(63)) & _U(1)).astype(bool)
        return ok


def _candidates(base: DataFrame, sized: DataFrame, k: int, pct: int, scratch: Scratch) -> DataFrame:
    """``doc_id, n, keys, shs`` of one text of each class that may be linked to another."""
    spark = base.sparkSession
    asked, texts = sized.agg(F.coalesce(F.sum("asked"), F.lit(0)), F.count("doc_id")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = base.mapInArrow(_seen(k, pct, max(tasks, -(-asked // RANGE))), "part long, once binary, owner binary, more binary, ids binary, times binary")
    shared = shared.groupBy("part").applyInArrow(_shared(max(tasks, -(-texts // RANGE))), "part long, ids binary, times binary")
    shared = shared.groupBy("part").applyInArrow(_totals, "doc_id long, shared long")
    may = sized.where((F.col("n") >= bands(pct)[0]) & F.col("doc_id").isNotNull()).join(shared, "doc_id", "left")
    may = may.where((F.col("asked") - F.coalesce("shared", F.lit(0))) * 100 <= F.col("n") * (100 - pct))
    reps = scratch.table(may.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id")), "reps")
    scratch.release_shuffles()
    if reps.count() <= _May.MOST:
        filtered = spark.sparkContext.broadcast(_May(reps.select("doc_id")))
        near = base.mapInArrow(_keyed(k, pct, filtered), "doc_id long, n long, d1 long, d2 long, keys array<long>, shs binary")
    else:
        own = base.join(reps.select("doc_id"), "doc_id", "left_semi")
        near = own.mapInArrow(_keyed(k, pct, None), "doc_id long, n long, d1 long, d2 long, keys array<long>, shs binary")
    one = ["doc_id", "d1", "d2", "n"]
    return scratch.table(near.join(reps, one).dropDuplicates(one).select("doc_id", "n", "keys", "shs"), "sets")


def _families(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, family``: components of the stars from each ``doc_id`` to the smallest one with an equal ``key``.

    Only keys whose rows differ in ``label`` count.
    """
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    # written, so that a join with a key of very many rows can be split
    keys = scratch.table(keys.select("key", "low"), "keys")
    stars = rows.join(keys, "key").where("doc_id <> low").select(F.col("doc_id").alias("src"), F.col("low").alias("dst")).distinct()
    return scratch.table(connected_components(stars).withColumnRenamed("component", "family"), "family")


def _links(sets: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """``src, dst``: a spanning forest of the true links."""
    rows = sets.select("doc_id", F.explode("keys").alias("key"), F.col("doc_id").alias("label"))
    sizes = sets.select("doc_id", "n")
    members = sizes.withColumn("label", F.col("doc_id")).join(_families(rows, scratch).withColumnRenamed("node", "doc_id"), "doc_id")
    found = None
    for turn in range(TURNS + 1):
        members = scratch.table(members, f"members{turn}")  # of each set its family, label and size only
        scratch.release_shuffles()
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
        size = scratch.table(members.groupBy("family").agg(parts.alias("parts")), f"size{turn}")
        dealt = members.join(size, "family").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("parts")))
        dealt = dealt.drop("n").distinct().join(sets.select("doc_id", "shs"), "doc_id")
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")) if turn == TURNS else F.col("own"))
        dealt = dealt.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "label", "shs")
        new = scratch.table(dealt.groupBy("family", "x", "y").applyInArrow(_verify(pct), "src long, dst long"), f"links{turn}", narrow=True)
        found = new if found is None else found.unionByName(new)
        wide = size.where("parts > 1")
        if turn == TURNS or wide.isEmpty():
            return found
        comp = connected_components(found).withColumnRenamed("node", "doc_id")
        left = members.drop("label").join(wide.select("family"), "family", "left_semi").drop("family").join(comp, "doc_id", "left")
        left = scratch.table(left.select("doc_id", "n", F.coalesce("component", "doc_id").alias("label")), f"labels{turn}")
        own = sets.select("doc_id", "keys").join(left.select("doc_id", "label").distinct(), "doc_id")
        rows = own.select("doc_id", F.explode("keys").alias("key"), "label")
        members = left.join(_families(rows, scratch).withColumnRenamed("node", "doc_id"), "doc_id")
    return found


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, pct: int = 90
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; see the module's text."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sized = scratch.table(base.mapInArrow(_digests(k, pct), "doc_id long, n long, d1 long, d2 long, asked long"), "sized", narrow=True)
    sets = _candidates(base, sized, k, pct, scratch)
    scratch.release_shuffles()
    links = _links(sets, pct, scratch)
    scratch.drop(sets)
    scratch.release_shuffles()
    classes = sized.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    # an id with several texts joins their classes
    one = F.struct("d1", "d2", "n")
    several = sized.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b")
    own = sized.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["d1", "d2", "n"])
    comp = connected_components(links.unionByName(own.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))))
    known = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    return sized.join(known, ["d1", "d2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
