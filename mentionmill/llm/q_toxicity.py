"""Driver query for toxicity."""

from pyspark.sql import functions as F

from .toxicity import learn, score

#: False without a doc_id; such rows are not learned from either.
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"
THRESHOLD = 0.7


def train(docs, labels):
    return learn(docs.where(f"doc_id is not null and not {HELD}"), labels.where(f"doc_id is not null and not {HELD}").select("doc_id", "toxic"))


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", F.expr(HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES = {}
