"""Driver query for language identification."""

from pyspark.sql import functions as F

from .language_id import identify, learn

#: False without a doc_id; such rows are not learned from either.
HELD = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def train(docs):
    return learn(docs.where(f"doc_id is not null and not {HELD}"))


def op4_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.expr(HELD).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES = {}
