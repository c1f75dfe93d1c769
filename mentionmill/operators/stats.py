"""Statistics of annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dataset_statistics(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: topics, documents, sentences, event and entity mentions, chains (distinct in each topic, then summed)."""
    s = sentences.groupBy("topic").agg(F.countDistinct("doc_id").alias("docs"), F.count_distinct("doc_id", "sent_id").alias("sents"))
    m = mentions.groupBy("topic").agg(
        F.count_if("is_event").alias("events"), F.count_if(~F.col("is_event")).alias("entities"),
        F.countDistinct(F.when(F.col("is_event"), F.col("chain"))).alias("event_chains"),
        F.countDistinct(F.when(~F.col("is_event"), F.col("chain"))).alias("entity_chains"),
    )
    both = s.join(m, "topic", "left").fillna(0)
    return both.agg(F.count(F.lit(1)).alias("topics"), *[F.sum(c).alias(c) for c in ("docs", "sents", "events", "entities", "event_chains", "entity_chains")])


def split_statistics(mentions: DataFrame, by: str = "split", types: tuple[str, ...] = ("ACT", "HUM", "NON", "LOC", "TIM", "UNK")) -> DataFrame:
    """Mentions of each type and distinct chains for each split."""
    return mentions.groupBy(by).agg(
        F.count(F.lit(1)).alias("mentions"), *[F.count_if(F.col("type") == t).alias(t.lower()) for t in types], F.countDistinct("chain").alias("chains")
    )


def gold_clusters(mentions: DataFrame, none: str = "-") -> DataFrame:
    """Mentions of each gold tag per topic and kind, untagged ones left out."""
    tagged = mentions.where(F.col("gold") != none)
    return tagged.groupBy("topic", "is_event", "gold").agg(F.array_sort(F.collect_list("mention")).alias("mentions"))


def cluster_tokens(mentions: DataFrame, by: list[str]) -> DataFrame:
    """All token ids of each cluster, in mention order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "tokens_ids")))
    return mentions.groupBy(*by).agg(F.flatten(F.transform(parts, lambda x: x["tokens_ids"])).alias("tokens_ids"))


def token_clusters(mentions: DataFrame, doc: str = "doc_id", cluster: str = "cluster_id") -> DataFrame:
    """Set of clusters of each token."""
    flat = mentions.select(doc, F.explode("tokens_ids").alias("token_id"), cluster)
    return flat.groupBy(doc, "token_id").agg(F.array_sort(F.collect_set(cluster)).alias("clusters"))


def cluster_members(mentions: DataFrame, by: list[str], mention: str = "mention") -> DataFrame:
    return mentions.groupBy(*by).agg(F.array_sort(F.collect_list(mention)).alias("mentions"))


def mean_vector(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Elementwise mean of the vectors of each group."""
    flat = rows.select(*by, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(*by, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vector))


def matched_predictions(mentions: DataFrame, by: list[str], flag: str = "has_gold") -> DataFrame:
    """Predicted mentions and how many of them met a gold one."""
    return mentions.groupBy(*by).agg(F.count(F.lit(1)).alias("predicted"), F.count_if(F.col(flag)).alias("matched"))
