"""Exact and approximate vector search over shards, with queries in blocks.

Both searches share one plan.  Equal vectors are one candidate with its k + 1
smallest ids (the window's limit is applied before the shuffle, so a hot vector
costs k + 1 rows a task); nothing beyond those can be in a top k.  Candidates
are hashed into shards, distinct query vectors into blocks; a task searches one
shard for one block.  What is sent for this grows with the rows times the queries,
divided by the size of shards and blocks: so a block holds up to ``BLOCK_BYTES`` of
vectors, and so does a shard where there are more than enough for all tasks;
smaller tables have shards of about ``SHARD_ROWS`` rows.  In a
first wave a query visits its home shard.  Its kth score there bounds the
result from below, and the second wave, over all other shards, gets that bound
and returns only what reaches it.

Vectors that are null, empty or hold null or non-finite values take no part,
nor do rows with a null id.  Vectors are compared only with those of their own
length.  Ties go to the smaller id; repeated rows of one id count once, with the
smallest of their vectors.  Only the two named columns are read, so the names of
others cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import Scratch

SHARD_ROWS, BLOCK_ROWS, BLOCK_BYTES = 8192, 1 << 16, 1 << 25


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """``vec_id long, v array<double>`` of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    out = out.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return out.where("exists(v, x -> x <> 0)") if nonzero else out


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(
    vectors: DataFrame, every: int, k: int, kernel: Callable, largest: bool, score_type: str,
    id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose id is divisible by ``every``.

    ``kernel(uids, X, Q, bounds, k)`` returns, for each query row, the (uids,
    scores) of its best k candidates that reach its bound (None: no bound).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "search")
    rows = usable(vectors, id_col, vec_col, nonzero).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = scratch.table(rows.withColumn("h", F.xxhash64("v")), "rows")
    first = Window.partitionBy("h", "v").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    classes = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.table(classes.select(F.col("ids")[0].alias("uid"), "v", "ids", F.size("v").alias("dim")), "classes")
    asked = rows.where(F.col("vec_id") % every == 0)
    keys = asked.groupBy("h", "v").agg(F.min("vec_id").alias("qkey"))
    keys = scratch.table(keys, "keys")
    (n_class, wide), n_query = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first(), keys.count()
    most = max(256, BLOCK_BYTES // (8 * wide))
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n_class // most), min(tasks, -(-n_class // SHARD_ROWS)))
    parts = max(1, -(-n_query // min(BLOCK_ROWS, most)))
    cand = classes.select(
        "uid", "v", "dim", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part")
    )
    home = keys.select(
        "qkey", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("qkey"), F.lit(shards)).alias("shard"),
        F.pmod(F.xxhash64("qkey", F.lit(1)), F.lit(parts)).alias("part"), F.lit(None).cast(score_type).alias("bound"),
    )
    out = f"qkey long, found array<struct<uid:long,score:{score_type}>>"
    run = _task(kernel, k, score_type)

    def wave(q: DataFrame) -> DataFrame:
        by = ("dim", "shard", "part")
        return cand.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, out)

    near = scratch.table(wave(home), "near")
    if shards > 1:
        bounded = near.select("qkey", F.when(F.size("found") > k, F.col("found")[k]["score"]).alias("kth"))
        rest = home.drop("bound").join(bounded, "qkey", "left").select(
            "qkey", "v", "dim", F.explode(F.expr(f"array_remove(sequence(0L, {shards - 1}L), shard)")).alias("shard"), "part",
            F.col("kth").alias("bound"),
        )
        near = near.unionByName(wave(rest).where("size(found) > 0"))
    flat = near.groupBy("qkey").agg(F.flatten(F.collect_list("found")).alias("found"))
    sign = -1 if largest else 1
    # the k + 1 best classes, with their ids
    best = flat.select("qkey", F.slice(F.array_sort(F.transform("found", lambda x: F.struct((x["score"] * sign).alias("s"), x["uid"].alias("uid")))), 1, k + 1).alias("found"))
    wide = best.select("qkey", F.explode("found").alias("x")).join(classes.select("uid", "ids"), F.col("x.uid") == F.col("uid"))
    wide = wide.select("qkey", F.transform("ids", lambda i: F.struct(F.col("x.s").alias("s"), i.alias("id"))).alias("ids"))
    ranked = wide.groupBy("qkey").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("best"))
    per_query = asked.join(keys, ["h", "v"]).select("vec_id", "qkey").join(ranked, "qkey")
    own = per_query.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (F.col("x.s") * sign).cast(score_type).alias("score")
    )


def _task(kernel: Callable, k: int, score_type: str):
    kind = pa.int64() if score_type == "long" else pa.float64()
    found = pa.list_(pa.struct([("uid", pa.int64()), ("score", kind)]))
    schema = pa.schema([("qkey", pa.int64()), ("found", found)])

    def run(cand: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(cand):
            return pa.table({"qkey": [], "found": []}, schema=schema)
        uids = cand.column("uid").to_numpy()
        order = np.argsort(uids, kind="stable")
        got = kernel(uids[order], matrix(cand.column("v"))[order], matrix(asked.column("v")), asked.column("bound").to_pylist(), k + 1)
        size = np.concatenate([[0], np.cumsum([len(u) for u, _ in got])]).astype(np.int32)
        parts = [np.concatenate([u for u, _ in got]), np.concatenate([s for _, s in got])]
        items = pa.StructArray.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], kind)], ["uid", "score"])
        return pa.table([asked.column("qkey").combine_chunks(), pa.ListArray.from_arrays(pa.array(size), items)], schema=schema)

    return run
