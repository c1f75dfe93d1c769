"""Streaming additions: running pair metrics, sessions, windows and incremental matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import confusion


def read_stream(spark: SparkSession, folder: str, table: str, max_files: int = 8) -> DataFrame:
    """A table of a folder as a stream; a table in one file is the folder's only file of that name.

    Times without a zone are taken as UTC.
    """
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    out = reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return out.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])


def running_confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Confusion counts of a stream of predictions (update mode; state is a row for each group)."""
    return predictions.groupBy(*by).agg(*confusion())


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours", by: list[str] = ()) -> DataFrame:
    """Counts and sums per window (append mode: a window is given once, when the watermark passes its end, and its state dropped)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a key parted by at least ``gap`` (append mode: given once no event can join)."""
    s = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def dedupe_stream(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each combination of keys within the watermark (append mode)."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
