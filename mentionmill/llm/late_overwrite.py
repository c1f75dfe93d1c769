"""Partition overwrite for rows that arrive late.

A layout keeps the latest-arrived row of each id and cuts each day, in an order,
into Parquet files of a fixed number of rows, the last of a day perhaps fewer;
it is a folder partitioned by day and number of file.  ``overwrite`` brings late
rows into a layout and rewrites only the days that they change:

* the late rows' ids set bits of a Bloom filter; its words are made by one
  grouping, so no task and no broadcast holds more than the filter's fixed size
  (1 MB; more ids than it was sized for only let more rows through);
* the scan of the starting files reads ids and days, and drops what the filter
  does not hold;
* an exact semi-join with the late ids removes false positives;
* the days on which these sales stood, united with the days of the late rows
  that are kept, are rewritten (dynamic partition overwrite), and files of these
  days that the new ones do not replace are deleted.  Other files stay as they
  are, byte for byte.

Rows are numbered by range partitions, so a day of any size is sorted and cut by
many tasks; a file is written by one task, streaming.  Where the latest arrival
is tied, the larger of the other columns counts, a null less than any value (map
columns do not count).  Rows without an arrival are the oldest of their id.  A
late row replaces a standing one unless it has no arrival or an earlier one.
Rows without an id are one sale.  A day is the whole days of a time since 1970,
-1 without a time.  Columns may have any name.  Empty tables give empty layouts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import Scratch
from .columns import quoted, unused

#: 64-bit words of the Bloom filter, words of a piece of it, and bits that an id sets in its word.
WORDS, PIECE, BITS = 1 << 17, 1 << 12, 4


def day_of(df: DataFrame, column: str) -> Column:
    """Whole days since 1970, -1 for null; times with a zone are taken in UTC."""
    c = quoted(column)
    if dict(df.dtypes)[column] == "timestamp":
        days = f"floor(unix_micros({c}) / 86400000000)"
    else:
        days = f"datediff(cast({c} as date), date'1970-01-01')"
    return F.expr(f"coalesce(cast({days} as bigint), -1L)")


def latest(rows: DataFrame, id_col: str, arrived: str) -> DataFrame:
    """The latest-arrived row of each id; combined on the map side, so an id with any share of the rows is no hot key."""
    names = rows.columns
    order = [arrived, *[c for c, t in rows.dtypes if c != arrived and "map<" not in t and "variant" not in t]]
    whole, place = (F.struct(*[F.col(quoted(c)) for c in some]) for some in (names, order))
    best = rows.groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max_by(whole, place).alias("row"))
    return best.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in names])


def id_hash(id_col: str) -> Column:
    return F.xxhash64(F.col(quoted(id_col)))


def bloom_filter(rows: DataFrame, id_col: str, words: int = WORDS) -> np.ndarray:
    """``words`` 64-bit words of a blocked Bloom filter (a power of two, at least ``PIECE``).

    The words are grouped by Spark and come to the driver in dense pieces, so what
    it gets has the filter's size, however many ids there are.
    """
    h = id_hash(id_col)
    mask = _bit(h, 0)
    for k in range(1, BITS):
        mask = mask.bitwiseOR(_bit(h, k))
    bits = rows.select(h.bitwiseAND(F.lit(words - 1)).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))

    def dense(key, table):
        piece = np.zeros(PIECE, np.int64)
        piece[table.column("word").to_numpy() % PIECE] = table.column("mask").to_numpy()
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([piece.tobytes()], pa.binary())})

    pieces = bits.groupBy(F.floor(F.col("word") / PIECE).alias("piece")).applyInArrow(dense, "piece long, words binary").collect()
    out = np.zeros(words, np.int64)
    for r in pieces:  # at most words / PIECE rows
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.words, np.int64)
    return out


def _bit(h: Column, k: int) -> Column:
    """The k-th of the bits that an id sets in its word."""
    place = F.shiftrightunsigned(h, 24 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def held_by(spark: SparkSession, bits: np.ndarray):
    """A column function: may the filter hold an id of this hash?"""
    shared, last = spark.sparkContext.broadcast(bits), len(bits) - 1  # of the filter's fixed size

    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            h = s.to_numpy(np.int64)
            word = shared.value[h & last].view(np.uint64)
            found = np.ones(len(h), bool)
            for k in range(BITS):
                found &= (word >> (h.view(np.uint64) >> np.uint64(24 + 6 * k) & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield pd.Series(found)

    return F.pandas_udf(test, "boolean")


class Layout:
    """A folder of files by day, with the columns of ``like``."""

    def __init__(self, like: DataFrame, folder: str, id_col: str, at: str, arrived: str, per_file: int):
        self.spark, self.schema, self.names = like.sparkSession, like.schema, like.columns
        self.folder, self.id_col, self.at, self.arrived, self.per_file = folder, id_col, at, arrived, per_file
        self.day, self.file = unused(self.names, "day"), unused(self.names, "file_no")
        self.scratch = Scratch(self.spark, "layout")

    def write(self, rows: DataFrame) -> None:
        """Write the files of the days that stand in ``rows`` (one row of each id), in place of what these files were."""
        part, place, first, before = (unused([*self.names, self.day, self.file], n) for n in ("part", "place", "first", "before"))
        order = [F.col(self.day), F.col(quoted(self.at)).asc_nulls_first(), F.col(quoted(self.id_col)).asc_nulls_first()]
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn(self.day, day_of(rows, self.at)).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()
        dealt = dealt.withColumn(part, F.shiftright(number, 33)).withColumn(place, number.bitwiseAND(F.lit((1 << 33) - 1)))
        dealt = self.scratch.table(dealt, "dealt")
        # a row for each pair of a range partition and a day: at most as many as partitions and days together
        sizes = dealt.groupBy(part, self.day).agg(F.count(F.lit(1)).alias(before), F.min(place).alias(first))
        earlier = Window.partitionBy(self.day).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
        cut = dealt.join(F.broadcast(sizes), [part, self.day])
        cut = cut.withColumn(self.file, F.floor((F.col(before) + F.col(place) - F.col(first)) / self.per_file).cast("long"))
        cut = cut.select(*[F.col(quoted(c)) for c in self.names], self.day, self.file)
        cut = cut.repartition(tasks, self.day, self.file).sortWithinPartitions(self.day, self.file, *order[1:])
        cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy(self.day, self.file).parquet(self.folder)
        self.scratch.drop(dealt)

    def read(self) -> DataFrame:
        schema = type(self.schema)(list(self.schema.fields)).add(self.day, "long").add(self.file, "long")
        return self.spark.read.schema(schema).parquet(self.folder)

    def files(self) -> DataFrame:
        """``path, day, file_no`` of every data file, from the listing."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.folder)
        at = lambda name: F.regexp_extract("path", rf"/{name}=(-?\d+)/", 1).cast("long")
        return found.select("path", at(self.day).alias("day"), at(self.file).alias("file_no"))

    def overwrite(self, late: DataFrame, words: int = WORDS) -> None:
        """Bring ``late`` rows in; afterwards the folder is the layout of all rows."""
        s, key, day = self.scratch, quoted(self.id_col), self.day
        best = s.table(latest(late, self.id_col, self.arrived), "late")
        may = held_by(self.spark, bloom_filter(best, self.id_col, words))
        # the starting files: ids and days of what the filter holds
        start = self.read().select(F.col(key).alias("id"), F.col(quoted(self.arrived)).alias("stood"), F.col(day).alias("old_day"))
        start = start.where(may(F.xxhash64("id")))
        exact = F.col("id").eqNullSafe(F.col("late_id"))
        late_ids = best.select(F.col(key).alias("late_id"), F.col(quoted(self.arrived)).alias("comes"))
        wins = F.col("comes").isNotNull() & (F.col("stood").isNull() | (F.col("comes") >= F.col("stood")))
        # joins on ids are merged, never broadcast: both sides grow with the input
        met = s.table(start.join(late_ids.hint("merge"), exact).select("id", "old_day", wins.alias("wins")), "met")
        kept = best.join(met.where("not wins").select("id").hint("merge"), F.col(key).eqNullSafe(F.col("id")), "left_anti")
        kept = kept.withColumn(day, day_of(kept, self.at))
        days = met.where("wins").select(F.col("old_day").alias(day)).union(kept.select(day)).distinct()
        days = s.table(days, "days", narrow=True)  # a row for each day of the calendar at most
        stay = self.read().join(F.broadcast(days), day, "left_semi")
        stay = stay.join(met.where("wins").select("id").hint("merge"), F.col(key).eqNullSafe(F.col("id")), "left_anti")
        columns = [F.col(quoted(c)) for c in self.names]
        stood = s.table(self.files().join(F.broadcast(days.withColumnRenamed(day, "day")), "day", "left_semi"), "stood", narrow=True)
        self.write(stay.select(*columns).unionByName(kept.select(*columns)))
        # the dynamic overwrite has replaced the files of the numbers that still exist; those of others go
        now = self.files().select("path")
        left = stood.join(now, "path", "left_semi").select("path")
        gone = [r.path for r in left.toLocalIterator()]  # files of rewritten days that have no successor
        self._delete(gone)
        s.drop(best, met, days, stood)

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            file = jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(conf).delete(file.getParent(), True)

    def digests(self, started: DataFrame) -> DataFrame:
        """A row for each file, read back in the file's order; ``started`` are the starting files (``path``)."""
        rows = self.read().select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("nth"), F.col(self.day).alias("day"), F.col(self.file).alias("file_no"),
            F.col(quoted(self.id_col)).alias("id"), F.col(quoted(self.at)).alias("sold"), F.col(quoted(self.arrived)).alias("arrived"),
            F.floor(F.col("total") * 100 + 0.5).cast("long").alias("cents"),
        )
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, "path").sortWithinPartitions("path", "nth")  # a file is hashed in its order by one task, streaming
        found = rows.mapInArrow(_digest, "path string, day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")
        columns = ",".join(self.names)
        known = started.select(F.col("path").alias("known")).distinct()
        return found.join(known, _plain("path") == _plain("known"), "left").select(
            "day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(columns).alias("columns"), "ids_sha256", F.col("known").isNull().alias("rewritten")
        )


def _plain(path: str) -> Column:
    """A path with one form of its scheme (``file:/`` and ``file:///``)."""
    return F.regexp_replace(F.col(path), "^file:/+", "/")


def _digest(batches):
    """Sums and the hash of ids of each file; rows come by file and place."""
    from zlib import crc32

    schema = pa.schema([("path", pa.string()), *[(n, pa.int64()) for n in ("day", "file_no", "n_rows", "cents", "rows_crc")], ("ids_sha256", pa.string())])
    micros = lambda c: c.cast(pa.timestamp("us", c.type.tz) if pa.types.is_timestamp(c.type) else c.type).cast(pa.int64()).to_pylist()
    say = lambda x: "" if x is None else str(x)
    at = None

    def done():
        return pa.record_batch([[v] for v in (*at[:6], at[6].hexdigest())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column("path").to_pylist()
        ids, cents = batch.column("id").to_pylist(), batch.column("cents").to_pylist()
        sold, arrived = micros(batch.column("sold")), micros(batch.column("arrived"))
        days, files = batch.column("day").to_pylist(), batch.column("file_no").to_pylist()
        lo = 0
        while lo < len(paths):
            hi = lo + 1
            while hi < len(paths) and paths[hi] == paths[lo]:
                hi += 1
            if at is None or at[0] != paths[lo]:
                if at is not None:
                    yield done()
                at = [paths[lo], days[lo], files[lo], 0, 0, 0, sha256()]
            at[6].update((("," if at[3] else "") + ",".join(map(say, ids[lo:hi]))).encode())
            at[3] += hi - lo
            at[4] += sum(c or 0 for c in cents[lo:hi])
            at[5] += sum(crc32(f"{say(i)}:{say(a)}:{say(b)}".encode()) for i, a, b in zip(ids[lo:hi], sold[lo:hi], arrived[lo:hi]))
            lo = hi
    if at is not None:
        yield done()
