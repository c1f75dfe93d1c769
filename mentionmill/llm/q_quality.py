"""Driver query for quality."""

from pyspark.sql import functions as F

from .quality import learn, score

#: False without a doc_id; such rows are not learned from either.
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"
THRESHOLD = 0.7


def train(docs, labels):
    own = f"doc_id is not null and not {HELD}"
    return learn(docs, docs.where(own), labels.where(own).select("doc_id", "quality"))


def op11_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.expr(HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op11_quality": op11_quality}
ORACLES = {}
