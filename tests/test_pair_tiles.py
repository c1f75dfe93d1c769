"""Pairs that stay in their tiles, and what is known of pairs without making them, against plain joins."""

import pytest
from pyspark.sql import functions as F

from mentionmill.operators import matching, pairs, scoring
from mentionmill.plans import bindings as B
from mentionmill.plans import registry

SF = "/root/testdata/sf0.001"
SCHEMA = "topic long, doc_id long, sent_id long, gold long, mention long, pos long"


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [(i % 3, i % 7, i // 7 % 4, i % 5, i, i // 2 if i % 3 else i) for i in range(60)]
    rows += [(1, None, 1, 2, 70, 70), (1, 2, None, 2, 71, 71), (1, 2, 1, None, 72, 72), (None, 2, 1, 1, 73, 73), (2, 2, 1, 1, 74, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tasks_grow_with_pairs(spark, mentions, monkeypatch):
    small = pairs.within_block(mentions, "topic").rdd.getNumPartitions()
    monkeypatch.setattr(pairs, "TASK_PAIRS", 16)
    monkeypatch.setattr(pairs, "STRIPE", 4)
    p = pairs.within_block(mentions, "topic", tile="tile")
    assert pairs.tasks_of_pairs(mentions, "topic") > 5 * small
    assert p.withColumn("p", F.spark_partition_id()).groupBy("topic", "tile").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert p.groupBy("m1_mention", "m2_mention", "topic").agg(F.countDistinct("tile").alias("n")).where("n > 1").count() == 0


def test_scope_counts(spark, mentions):
    p = pairs.with_label(pairs.with_scope(pairs.within_block(mentions, "topic"))).cache()
    want = [(s, *p.where(pairs.scope_filter(s)).agg(F.count(F.lit(1)), F.sum("label")).first()) for s in pairs.SCOPES]
    assert rows(pairs.scope_counts(mentions, "topic")) == sorted(want, key=str)
    assert rows(pairs.scope_counts(mentions.limit(0), "topic")) == sorted([(s, 0, None) for s in pairs.SCOPES], key=str)


@pytest.mark.parametrize("inner, outer", [("doc_id", "topic"), ("topic", "doc_id")])
def test_strategy_subset(mentions, inner, outer):
    for m in (mentions, mentions.withColumn("mention", F.col("mention") % 20)):  # in the second a mention has several blocks
        want = pairs.subset_check(pairs.within_block(m, inner), pairs.within_block(m, outer), ["m1_mention", "m2_mention"])
        assert rows(pairs.strategy_subset(m, inner, outer)) == rows(want)


def test_indexed(spark, mentions):
    m = mentions.withColumn("mention", F.col("pos")).unionByName(mentions.withColumn("mention", F.col("pos")).where("pos = 9"))
    got = pairs.indexed(m, "topic").select("topic", "m1_pos", "m2_pos", "index").orderBy("index").collect()
    want = sorted((r.topic, r.m1_pos, r.m2_pos) for r in pairs.within_block(m, "topic").collect())
    assert [tuple(r) for r in got] == [(*w, i) for i, w in enumerate(want)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_canonical_and_left_join_stay_in_tiles(spark):
    """Neither shuffles pairs: there are no more exchanges than the pairs need that they are made of."""
    p = exchanges(B.predictions(spark, SF, tile="tile"))
    assert exchanges(registry.QUERIES["votes_to_predictions"](spark, SF)) == p
    assert exchanges(registry.QUERIES["left_join_default"](spark, SF)) == 2 * p  # the pairs of either side


def test_left_join_by_tile(spark):
    gold = spark.createDataFrame([(1, 5, 2, 0), (1, 2, 3, 1), (1, 2, 3, 1), (2, 8, 9, 1), (2, 7, 9, 0)], "t long, a long, b long, label int")
    pred = spark.createDataFrame([(1, 2, 5, 1), (1, 5, 2, 1), (1, 3, 2, None), (3, 1, 2, 1), (2, 9, 8, 1)], "t long, a long, b long, pred int")
    got = matching.left_with_default(gold, pred, by=["t"])
    assert rows(got) == rows(matching.left_with_default(gold, pred.drop("t")).select(got.columns))


def test_adjacency_of_many_tasks(spark):
    p = spark.createDataFrame([(1, 1, 2, True), (1, 2, 1, True), (1, 1, 3, True), (1, 2, 3, False), (1, 4, 5, None), (2, 1, 2, True)], "block long, a long, b long, pred boolean").repartition(4)
    assert rows(scoring.adjacency(p)) == rows(spark.createDataFrame([(1, 1, [2, 3]), (1, 2, [1]), (1, 3, [1]), (1, 4, []), (1, 5, []), (2, 1, [2]), (2, 2, [1])], "block long, m long, neighbours array<long>"))


def test_adjacency_shuffles_lists(spark):
    """No row of two ends is made of a pair: tasks list their own pairs by either end."""
    p = spark.createDataFrame([(k, i, j, i % 2 == j % 2) for k in range(3) for i in range(12) for j in range(i + 1, 12)], "block long, a long, b long, pred boolean").repartition(4)
    got = scoring.adjacency(p)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == sorted(((k, i, [j for j in range(12) if j != i and j % 2 == i % 2]) for k in range(3) for i in range(12)), key=str)
