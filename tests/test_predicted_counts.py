"""Neighbour counts of pairs that are made in tiles against those of the same pairs as rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mentionmill.operators import neighbours, pairs, scoring
from mentionmill.plans import bindings as B


@pytest.mark.parametrize("tile", [8, 1024])
def test_counts_equal_those_of_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(neighbours, "TILE", tile)
    m = spark.range(130).select(F.when(F.col("id") < 90, 1).when(F.col("id") < 128, 2).when(F.col("id") < 129, 3).cast("long").alias("doc_id"), (F.col("id") * 3).alias("mention"), F.when(F.col("id") % 17 > 0, F.col("id") % 3).alias("gold"), (F.col("id") * 2).alias("pos"))
    got = neighbours.predicted_counts(m, "doc_id", B.predict, B.PREDICTED)
    p = pairs.within_block(m, "doc_id")
    mix, same = (F.col("m1_mention") * 7 + F.col("m2_mention") * 13) % 11, F.col("m1_gold") == F.col("m2_gold")
    rows = p.select(F.col("doc_id").alias("block"), F.col("m1_mention").alias("a"), F.col("m2_mention").alias("b"), F.when(mix == 0, None).when(mix <= 2, ~same).otherwise(same).alias("pred"), same.alias("truth"))
    want = scoring.neighbour_counts(rows).select(got.columns)
    text = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert text(got) == text(want) and got.count() == 90 * 89 // 2 + 38 * 37 // 2


def test_blocks_without_links(spark):
    m = spark.range(4).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("mention"), F.col("id").alias("gold"), F.col("id").alias("pos"))
    none = lambda t: B.predict(t).set_column(3, "pred", pa.array([False] * len(t)))
    assert [(r.both, r.one) for r in neighbours.predicted_counts(m, "doc_id", none, B.PREDICTED).collect()] == [(0, 0), (0, 0)]


def test_scores_make_no_pairs_by_joins(spark):
    """Before, pairs were rows of a join three times over and were shuffled."""
    from mentionmill.plans import registry

    for name in ("score_neighbour_votes", "score_naive_bayes"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "m1_" not in plan and "FlatMapCoGroupsInArrow" in plan
