"""Tables written in the cluster's shared folder to cut lineage.

The folder is the one named by ``spark.checkpoint.dir``.  Where that is unset, a
folder under the system's temporary one is used if driver and executors are one
process (``local[...]``); on a cluster it is an error, as executors would not see
each other's files.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="mentionmill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL["dir"] = "file://" + folder
        found = _LOCAL["dir"]
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/mentionmill/{label}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables of one operator run: written once, read back, dropped when no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written files.

        ``narrow``: its rows are few or small beside what they were made of, so they
        are gathered first, in as many files as their size needs.  Each file that
        is made on a local disk costs a fork of the executor's JVM (``chmod``).
        """
        if narrow:
            df = df.hint("rebalance")
        path = new_path(self.spark, f"{self.label}-{name}")
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables that nothing reads any more, and let Spark drop finished shuffles."""
        jvm = self.spark._jvm
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                hpath = jvm.org.apache.hadoop.fs.Path(path)
                fs = hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
                fs.delete(hpath, True)

    def release_shuffles(self) -> None:
        """Have the JVM collect, so that its cleaner removes shuffle files of finished steps."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
