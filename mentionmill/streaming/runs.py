"""Running streams into files, to a checkpoint, once for what is there now.

A watermark only moves with rows, so the last windows of a stream that ends are
never closed.  ``Closing`` gives such a stream an end: a second source, empty at
first, into which a row of nulls with a time is written when all else has been
read.  Filters may be pushed below a watermark, and joins filter null keys: such
columns get a value of their own in these rows (``marks``), to be left out of
what is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import new_path

#: The end of time for streams that are closed; two, as a watermark counts from the batch after.
ENDS = ("2200-01-01 00:00:00", "2200-01-02 00:00:00")


class Closing:
    """A stream that can be closed; its ``rows`` are those of ``stream`` and, once it is closed, rows of a time, the ``marks`` and nulls."""

    def __init__(self, stream: DataFrame, time: str, **marks):
        self.spark, self.schema, self.time, self.marks = stream.sparkSession, stream.schema, time, marks
        self.folder = new_path(self.spark, "closing")
        self._write(None)
        self.rows = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def _write(self, at: str | None) -> None:
        row = self.spark.range(1 if at else 0).select(*[F.lit(at if f.name == self.time else self.marks.get(f.name)).cast(f.dataType).alias(f.name) for f in self.schema])
        row.coalesce(1).write.mode("append").parquet(self.folder)

    def close(self, run) -> None:
        """``run()`` what is there, then again after each end."""
        run()
        for at in ENDS:
            self._write(at)
            run()


class Output:
    """Files of a stream's rows, and its checkpoint, in new folders of the shared one; a stopped run goes on from the checkpoint."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.checkpoint = spark, new_path(spark, f"{label}-rows"), new_path(spark, f"{label}-checkpoint")
        self.progress: list = []

    def append(self, df: DataFrame) -> None:
        """Run over what is there now, in append mode; a batch's files count only once its commit is in the sink's log."""
        writer = df.writeStream.outputMode("append").format("parquet").option("path", self.path).option("checkpointLocation", self.checkpoint)
        self._finish(writer.trigger(availableNow=True).start())

    def update(self, df: DataFrame) -> None:
        """Run in update mode; a batch's rows are a folder of its own, written over if the batch is repeated."""

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        self._finish(df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())

    def _finish(self, query) -> None:
        query.awaitTermination()
        self.progress += query.recentProgress

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def latest(self, keys: list[str]) -> DataFrame:
        """Of ``update``: the last row of each key."""
        rows = self.read()
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("last"))
        return last.select(*keys, "last.*")
