"""Projections, predicates, set operations and validations of the flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..storage import Scratch

#: Tag and chain-id parts in the order they are tested, with the mention types.
TAG_TYPES = (("ACTION", "ACT"), ("LOC", "LOC"), ("NON", "NON"), ("HUMAN", "HUM"), ("TIME", "TIM"))
CHAIN_TYPES = (("ACT", "ACT"), ("NEG", "ACT"), ("LOC", "LOC"), ("NON", "NON"), ("HUM", "HUM"), ("CON", "HUM"), ("TIM", "TIM"), ("UNK", "UNK"))
#: Dev and training topics of each setup; all others are test topics.
SPLITS = {
    1: {"dev": (23, 24, 25), "train": tuple(range(1, 23))},
    2: {"dev": (2, 5, 12, 18, 21, 23, 34, 35), "train": tuple(t for t in range(1, 36) if t not in (2, 5, 12, 18, 21, 23, 34, 35))},
}


def tag_selected(sentences: DataFrame, selected: DataFrame, doc: str = "doc_id", sent: str = "sent_id") -> DataFrame:
    """``is_selected`` from the list of selected sentences."""
    s = selected.select(doc, sent).distinct().withColumn("_s", F.lit(True))
    return sentences.join(s, [doc, sent], "left").withColumn("is_selected", F.coalesce("_s", F.lit(False))).drop("_s")


def drop_unselected(mentions: DataFrame, selected: DataFrame, doc: str = "doc_id", sent: str = "sent_id") -> DataFrame:
    return mentions.join(selected.select(doc, sent).distinct(), [doc, sent], "left_semi")


def topics(df: DataFrame, names: list, col: str = "topic") -> DataFrame:
    return df.where(F.col(col).isin(*names))


def topic_number(topic: str = "topic_id") -> Column:
    return F.split(topic, "_")[0].cast("int")


def doc_to_subtopic(doc: str = "doc_id") -> Column:
    """36_1ecb -> 36_ecb."""
    return F.regexp_replace(doc, "_[0-9]+", "_")


def split_name(topic: str | Column, setup: int = 2, splits: dict | None = None) -> Column:
    t = F.col(topic) if isinstance(topic, str) else topic
    s = splits or SPLITS[setup]
    return F.when(t.isin(*s["dev"]), "dev").when(t.isin(*s["train"]), "train").otherwise("test")


def is_event(chain: str | Column) -> Column:
    c = F.col(chain) if isinstance(chain, str) else chain
    return c.contains("ACT") | c.contains("NEG")


def _ordered(col: Column, tests, exact: tuple[str, str] | None = None) -> Column:
    out = F.when(col == exact[0], exact[1]) if exact else None
    for part, kind in tests:
        out = out.when(col.contains(part), kind) if out is not None else F.when(col.contains(part), kind)
    return out


def tag_to_type(tag: str) -> Column:
    return _ordered(F.col(tag), TAG_TYPES, ("UNKNOWN_INSTANCE_TAG", "UNK"))


def chain_to_type(chain: str) -> Column:
    return _ordered(F.col(chain), CHAIN_TYPES)


def body_sentence(doc: str, sent: str, parse_all: bool = True) -> Column:
    """Sentence index in the body: web documents begin with their address, two also with a time."""
    s = F.col(sent)
    s = F.when(F.col(doc).contains("plus") & (s > 0), s - 1).otherwise(s)
    timed = F.col(doc).isin("9_3ecbplus", "9_4ecbplus") & F.lit(parse_all)
    return F.when(timed & (s > 0), s - 1).otherwise(s)


def is_continuous(tokens: str) -> Column:
    t = F.col(tokens)
    return t == F.sequence(F.get(t, F.lit(0)), F.get(t, F.size(t) - 1))


def is_singleton(chain: str) -> Column:
    return F.col(chain).contains("Singleton")


def without(df: DataFrame, skip: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not on a skip list (documents, bad tokens, header rows)."""
    return df.join(skip.select(*keys).distinct(), keys, "left_anti")


def drop_header_rows(df: DataFrame, col: str = "label") -> DataFrame:
    return df.where(F.coalesce(F.col(col) != col, F.lit(True)))


def near(pairs: DataFrame, sent: str = "sent_id", most: int = 1) -> DataFrame:
    return pairs.where(F.abs(F.col(f"m1_{sent}") - F.col(f"m2_{sent}")) <= most)


def probability_to_class(p: str = "pred_proba", threshold: float = 0.5) -> Column:
    return F.coalesce(F.col(p) >= threshold, F.lit(False)).cast("int")


def without_singletons(clusters: DataFrame, by: list[str]) -> DataFrame:
    n = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return clusters.join(n, by, "left_semi")


def unclustered(mentions: DataFrame, chain: str = "chain") -> DataFrame:
    """Mentions without a chain; none are expected."""
    return mentions.where(F.col(chain).isNull())


def chains_across_documents(mentions: DataFrame, doc: str = "doc_id", chain: str = "chain") -> DataFrame:
    """Within-document chains that occur in several documents; none are expected."""
    return mentions.groupBy(chain).agg(F.countDistinct(doc).alias("docs")).where("docs > 1")


def missing_topics(all_topics: DataFrame, used: DataFrame, col: str = "topic") -> DataFrame:
    return all_topics.select(col).exceptAll(used.select(col)).distinct()


def union_checked(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """Union by name; with ``expected`` a row count that must come out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if expected is None:
        return out
    seen = Observation()  # counted as the union is written, so its parts run once
    out = Scratch(out.sparkSession, "union").table(out.observe(seen, F.count(F.lit(1)).alias("n")), "rows")
    if (n := seen.get["n"]) != expected:
        raise ValueError(f"{n} rows, expected {expected}")
    return out


def augment(rows: DataFrame, more: DataFrame, kind: str, topic: str = "topic") -> DataFrame:
    """Training rows joined by others: under the same topic names, or under names of their own."""
    extra = more if kind == "same" else more.withColumn(topic, F.concat(F.col(topic), F.lit("_more")))
    return rows.unionByName(extra)


def first_documents(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    return docs.orderBy(order).limit(n)


def balanced_first(rows: DataFrame, n: int, label: str = "label", order: str = "pos", by: list[str] = ()) -> DataFrame:
    """First n/2 rows of each label in source order."""
    w = Window.partitionBy(*by, label).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n // 2).drop("_rn")


def first_example(rows: DataFrame, by: list[str], label: str = "label", order: str = "pos") -> DataFrame:
    """First positive and first negative row of each document."""
    return balanced_first(rows, 2, label, order, by)


def top_share(spans: DataFrame, by: str, score: str, tokens: str, share: float = 0.25, tie: str = "span") -> DataFrame:
    """Best ``share`` of the token count of spans in each topic."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return spans.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.floor(F.col(tokens) * share)).drop("_rn")


def mention_id(sep: str = "_", doc: str = "doc_id", sent: str = "sent_id", start: str = "start", end: str = "end") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in (doc, sent, start, end)])


def conll_order() -> list[Column]:
    """Main documents before the added ones, then document, sentence and descending start."""
    return [F.col("doc_id").contains("plus").asc(), F.col("topic_id").asc(), F.col("doc_id").asc(), F.col("sent_id").asc(), F.col("start").desc()]


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in an order, by range partitions: places within a partition, plus the rows of those before it."""
    held = Scratch(rows.sparkSession, "numbered").table(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))  # a row for each partition
    out = held.withColumn("_part", part).join(sizes, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_part", "_before", "_at")


def running_sums(rows: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """``columns`` as running sums in an order of distinct values, by range partitions: sums within a partition, plus those of the ones before it."""
    held = Scratch(rows.sparkSession, "running").table(rows.orderBy(order).withColumn("_part", F.spark_partition_id()), "rows")
    inner = Window.partitionBy("_part").orderBy(order)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])  # a row for each partition
    totals = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns])
    run = held.withColumns({c: F.sum(c).over(inner) for c in columns}).join(totals, "_part")
    return run.withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in columns}).drop("_part", *[f"_before_{c}" for c in columns])


def running_index(rows: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Rows numbered from 0 in an order, as predictions are matched to their pairs."""
    return numbered(rows, order, "_number").withColumn(name, F.col("_number") - 1).drop("_number")


def present(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have all of some columns (mentions that were found)."""
    return rows.dropna(how="any", subset=columns)


def by_first_token(mentions: DataFrame, by: list[str], tokens: str = "tokens_ids") -> DataFrame:
    """``nth``: place of a mention in its document by its first token, then by all of them; from 1."""
    w = Window.partitionBy(*by).orderBy(F.get(tokens, F.lit(0)).asc_nulls_last(), tokens)
    return mentions.withColumn("nth", F.row_number().over(w))


def offset_clusters(rows: DataFrame, topic: str = "topic", cluster: str = "cluster") -> DataFrame:
    """Cluster numbers made distinct over topics: each topic's begin after the largest one before it."""
    w = Window.partitionBy(F.lit(0)).orderBy(topic).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(topic).agg((F.max(cluster) + 1).alias("_n"))  # a row for each topic
    starts = sizes.select(topic, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return rows.join(starts, topic).withColumn(cluster, F.col(cluster) + F.col("_start")).drop("_start")


def first_appearance(rows: DataFrame, value: str, order: str, block: list[str] = ()) -> DataFrame:
    """``number``: dense index of a value by its first place (from 0).

    First places come from one aggregation; the numbering orders distinct values only.
    """
    first = rows.groupBy(*block, value).agg(F.min(order).alias("_first"))
    if block:
        number = F.row_number().over(Window.partitionBy(*block).orderBy("_first", value)) - 1
        return rows.join(first.select(*block, value, number.alias("number")), [*block, value])
    placed = numbered(first, ["_first", value], "number")
    return rows.join(placed.select(value, (F.col("number") - 1).alias("number")), value)
