"""Token-ID files: encode documents, write Simple-8b files in id order, read them back.

Documents are range-partitioned by id and sorted, encoded in Arrow batches, and
each partition writes files of about ``FILE_TOKENS`` ids straight to a folder
that all executors share (any store that ``pyarrow.fs`` opens).  A file is
written under a name of its attempt and then moved to its final name, so a
repeated task leaves the same files.  The manifest, a table in the shared folder
with a row for each file, gives the count of ids before each file: running sums
within a partition, within ``GROUP`` partitions and over these groups, so nothing
but one row for each ``GROUP`` partitions ever meets in one task, and nothing
reaches the driver.  Files are read by the tasks that hold their manifest rows.

Null texts count as empty (one end id); null ids sort first.  Repeated rows are
kept, each with its own place.  An empty table writes no file.  Only the two
named columns are read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..storage import Scratch
from .simple8b import from_bytes, null_ids, to_bytes
from .texthash import blocks, small_batches
from .tokenmemo import word_memo

FILE_TOKENS, GROUP = 1 << 20, 1024


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int):
    schema = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def flush(store, root, part, k, docs, ends, ids):
        name = f"part-{part:06d}-{k:05d}.s8b"
        trial = f"{root}/_trial-{uuid.uuid4().hex}"
        values = np.concatenate(ids)
        with store.open_output_stream(trial) as f:
            f.write(to_bytes(np.array([d or 0 for d in docs], np.int64), np.array(ends, np.int64), values, docs.count(None)))
        store.move(trial, f"{root}/{name}")
        return part, k, name, len(docs), len(values)

    def run(batches):
        from pyspark import TaskContext

        memo, part = word_memo(tokenizer), TaskContext.get().partitionId()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        docs, ends, ids, size, made = [], [], [], 0, []
        for batch in batches:
            for own, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got, off = memo.encode(texts, end_id)
                docs += own
                ends += (size + off[1:]).tolist()
                ids.append(got)
                size += len(got)
                if size >= FILE_TOKENS:
                    made.append(flush(store, root, part, len(made), docs, ends, ids))
                    docs, ends, ids, size = [], [], [], 0
        if docs:
            made.append(flush(store, root, part, len(made), docs, ends, ids))
        if made:
            yield pa.record_batch([list(c) for c in zip(*made)], schema=schema)

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files into ``folder`` and return the manifest ``file, n_docs, n_tokens, start``."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # as many parts as the scan has; a part is written as a stream, so its size only matters for the spread of work
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.rdd.getNumPartitions())
    sorted_docs = base.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )
    made = sorted_docs.mapInArrow(_writer(folder, tokenizer, end_id), "part long, k long, file string, n_docs long, n_tokens long")
    return _with_starts(Scratch(spark, "manifest").table(made, "files", narrow=True))


def _with_starts(made: DataFrame) -> DataFrame:
    """``file, n_docs, n_tokens, start``: the ids before each file, files in order of ``part`` and ``k``."""
    whole = lambda size, *order: Window.partitionBy(*size).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    group = F.floor(F.col("part") / GROUP).cast("long")
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("size")).withColumn("group", group)
    groups = parts.groupBy("group").agg(F.sum("size").alias("size")).select("group", before("size", whole((F.lit(0),), "group")).alias("at_group"))
    parts = parts.select("part", "group", before("size", whole(("group",), "part")).alias("at_part")).join(groups, "group")
    files = made.withColumn("at_file", before("n_tokens", whole(("part",), "k"))).join(parts, "part")
    return files.select("file", "n_docs", "n_tokens", (F.col("at_group") + F.col("at_part") + F.col("at_file")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    image = f.read()
                ids, ends, values = from_bytes(image)
                values = values.astype("<u4")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(values[a:b].data) for a, b in zip(begins.tolist(), ends.tolist())]
                none = np.arange(len(ids)) < null_ids(image)
                yield pa.record_batch([pa.array(ids, mask=none), pa.array(start + begins), pa.array(ends - begins), pa.array(crc, pa.int64())], schema=schema)

    files = manifest.select("file", "start")
    # a few files for each task; files of a part follow each other, so they are dealt by name
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // 8)
    return files.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
