"""Pairs dealt in stripes and tiles against the plain expressions on plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from mentionmill.functions.vectors import similarity
from mentionmill.operators import pairs

SCHEMA = "doc long, pos long, name string, vector array<float>"


@pytest.fixture(scope="module")
def mentions(spark):
    rnd = random.Random(3)
    rows = [(d, i, f"n{i}", [rnd.gauss(0, 1) for _ in range(5)]) for d, n in ((1, 70), (2, 9), (3, 1)) for i in range(n)]
    rows += [(2, 100, "none", None), (2, 101, "hole", [1.0, None, 0.0, 0.0, 0.0]), (2, 102, "zero", [0.0] * 5), (2, 103, "short", [1.0]), (2, 3, "same place", [1.0] * 5), (None, 4, "x", [1.0] * 5)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain(m):
    x, y = (m.select("doc", *[F.col(c).alias(f"m{k}_{c}") for c in m.columns if c != "doc"]) for k in (1, 2))
    return x.join(y, "doc").where("m1_pos < m2_pos")


def test_stripes(mentions, monkeypatch):
    monkeypatch.setattr(pairs, "STRIPE", 8)
    got = pairs.within_block(mentions.drop("vector"), "doc")
    want = plain(mentions.drop("vector"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # the 70 mentions of the largest block do not meet in one task
    most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < want.count()


@pytest.mark.parametrize("least", [None, 40.0])
def test_tiles(mentions, monkeypatch, least):
    monkeypatch.setattr(pairs, "TILE", 8)
    got = pairs.similar_pairs(mentions, "doc", least=least)
    want = plain(mentions).withColumn("similarity", similarity("m1_vector", "m2_vector")).drop("m1_vector", "m2_vector")
    if least is not None:
        want = want.where(F.col("similarity") >= least)
    text = lambda df: sorted((r.doc, r.m1_pos, r.m1_name, r.m2_pos, r.m2_name, round(r.similarity, 9)) for r in df.collect())
    assert text(got) == text(want)
