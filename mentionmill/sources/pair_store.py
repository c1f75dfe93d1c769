"""A store of mentions from which pairs are read without a shuffle.

A table partitioned by topic and bucketed by document: a topic's rows are read
from its own folder (static pruning by a filter, dynamic pruning by a join with
the topics asked for), and a document's rows lie in one bucket, so a join of the
store with itself by document needs no exchange.  Tables are in the session's
catalog; their files are in the folder given, which the cluster shares.  Topics and
documents that are null meet nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_store(mentions: DataFrame, table: str, path: str, buckets: int = 16) -> None:
    """Write ``topic, doc_id, ...`` as a new table; a topic's bucket is one file, sorted by document."""
    rows = mentions.repartition(buckets, "doc_id")
    rows.write.partitionBy("topic").bucketBy(buckets, "doc_id").sortBy("doc_id").format("parquet").option("path", path).saveAsTable(table)


def stored(spark: SparkSession, table: str, topics: list | DataFrame | None = None) -> DataFrame:
    """The store's mentions, of some topics: a list is a filter, a DataFrame of ``topic`` a join that prunes at run time."""
    rows = spark.table(table)
    if topics is None:
        return rows
    if isinstance(topics, DataFrame):
        return rows.join(topics.select("topic").distinct(), "topic", "left_semi")
    return rows.where(F.col("topic").isin(*topics))


def stored_pairs(spark: SparkSession, table: str, topics: list | DataFrame | None = None) -> DataFrame:
    """Pairs of mentions of one document, the first before the second by ``pos``: ``doc_id``, and ``m1_`` and ``m2_`` columns; joined bucket by bucket."""
    rows = stored(spark, table, topics)
    side = lambda k: rows.select("doc_id", *[F.col(c).alias(f"m{k}_{c}") for c in rows.columns if c != "doc_id"])
    return side(1).hint("merge").join(side(2), "doc_id").where("m1_pos < m2_pos")
