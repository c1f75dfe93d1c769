"""Corpus pipeline: language, toxicity, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Between stages the rows are written
as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mentionmill.llm import q_language, q_packing, q_toxicity
from mentionmill.llm.columns import quoted, unused
from mentionmill.llm.jaccard_join import jaccard_components
from mentionmill.llm.language_id import identify
from mentionmill.llm.secrets import redact
from mentionmill.llm.toxicity import score
from mentionmill.storage import Scratch

#: A text whose best language is less likely than this is rejected, as are texts without a letter.
LEAST_LANGUAGE = 0.5
#: A text whose n-grams are nearer to chance than to the training texts of its best language is in no known language.
LEAST_FIT = 0.5
#: Near copies share so many percent of their shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no known language."""
    names, model = docs.columns, q_language.train(docs)
    if not model.langs:  # nothing could be learned (no labelled text): nothing is rejected
        return docs
    found = unused(names, "found")
    own = (F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= LEAST_LANGUAGE) & (F.col(f"{found}.fit") >= LEAST_FIT)
    return identify(docs, model, keep=names, with_fit=True, into=found).where(own).select(*map(quoted, names))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are scored as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = q_toxicity.train(docs, labels)
    names = docs.columns
    found = unused(names, "found")
    return score(docs, model, keep=names, into=found).where(F.col(f"{found}.score") < q_toxicity.THRESHOLD).select(*map(quoted, names))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows that share an id are one document; each different text of it that is kept
    stays, once.  Documents without an id cannot be named by a group and stay.
    """
    names = docs.columns
    keep = jaccard_components(docs, k=NEAR_WORDS, pct=NEAR_PERCENT).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*map(quoted, names))
    return kept.unionByName(docs.where("doc_id is null"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return q_packing.packed(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("secret_scan", secrets_stage),
    ("best_fit", packing_stage),
]

#: Learned models and a tokenizer decide what the rows are; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        new = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = new
    return docs
