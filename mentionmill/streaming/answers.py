"""Answers to a stream of prompts that an interruption neither loses nor doubles.

Each batch of prompts is asked and its answers written as a folder of its own,
which counts once its success mark is there: that is the ledger.  A batch that
was written but not committed to the checkpoint comes again after a restart; its
folder is found whole and nobody is asked.  A batch that was stopped while it was
asked is asked again and its folder written over, so prompts are asked twice only
inside such a batch; ``max_files`` bounds its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.predictors import Predictor, predict


class AnswerLog:
    """Answers in ``path``, one folder for each batch, and the checkpoint beside it."""

    def __init__(self, spark: SparkSession, path: str, predictor: Predictor, repeat: int = 1, temperatures: tuple[float, ...] = (0.0,)):
        self.spark, self.path, self.predictor, self.repeat, self.temperatures = spark, path, predictor, repeat, temperatures

    def written(self, number: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/answers/batch={number}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def run(self, prompts: DataFrame, after_write: Callable[[int], None] = lambda number: None) -> None:
        """Answer the prompts (a column ``prompt``) that are there now and not answered yet; ``after_write`` is called before a batch is committed."""

        def put(batch: DataFrame, number: int) -> None:
            if not self.written(number):
                predict(batch, self.predictor, self.repeat, self.temperatures).write.mode("overwrite").parquet(f"{self.path}/answers/batch={number}")
            after_write(number)

        writer = prompts.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.path}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/answers").drop("batch")
