"""The pair store's plans, answers that survive interruptions, nested mentions and re-indexing without copies."""

import random

import compare
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mentionmill.operators import matching
from mentionmill.operators.pairs import within_block
from mentionmill.operators.predictors import KeywordPredictor
from mentionmill.plans import registry
from mentionmill.sources import pair_store
from mentionmill.storage import new_path
from mentionmill.streaming.answers import AnswerLog


@pytest.fixture(scope="module")
def store(spark):
    rnd = random.Random(1)
    rows = [(t, f"d{t}_{d}", m, rnd.randrange(3), m) for t in range(6) for d in range(7) for m in range(8)]
    df = spark.createDataFrame(rows, "topic long, doc_id string, mention long, gold int, pos long")
    pair_store.write_store(df, "mentions_of_tests", new_path(spark, "store"), buckets=4)
    yield df
    spark.sql("DROP TABLE mentions_of_tests")


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_pairs_are_joined_without_an_exchange(spark, store):
    got = pair_store.stored_pairs(spark, "mentions_of_tests", [1, 4])
    plan = executed(got)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "BroadcastHashJoin" not in plan
    assert plan.count("PartitionFilters: [isnotnull(topic") + plan.count("PartitionFilters: [topic") == 2
    want = within_block(store.where("topic in (1, 4)"), "doc_id")
    columns = ["doc_id", "m1_topic", "m1_mention", "m2_mention", "m2_gold"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    scan = [x for x in plan.split("FileScan")[1:]]
    assert len(scan) == 2 and all("SelectedBucketsCount: 4 out of 4" in x for x in scan)


def test_topics_of_a_join_prune_at_run_time(spark, store):
    topics = spark.createDataFrame([(2, "a"), (5, "a"), (3, "b")], "topic long, name string").where("name = 'a'")
    got = pair_store.stored_pairs(spark, "mentions_of_tests", topics)
    assert "dynamicpruning" in executed(got).lower()
    assert {r.m1_topic for r in got.select("m1_topic").distinct().collect()} == {2, 5}
    assert got.count() == within_block(store.where("topic in (2, 5)"), "doc_id").count()


def test_an_interrupted_run_asks_and_writes_nothing_twice(spark, tmp_path):
    class Counting:
        """Says yes, and writes down what it was asked."""

        def __init__(self, folder):
            self.folder = folder

        def answer(self, prompts: pd.Series, temperature: float) -> pd.Series:
            import os
            import uuid

            os.makedirs(self.folder, exist_ok=True)
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(prompts))
            return KeywordPredictor("x").answer(prompts, temperature)

    folder = new_path(spark, "prompts")
    for k in range(4):
        spark.createDataFrame([(i, f"p{i} {'x' if i % 3 == 0 else 'y'}") for i in range(10 * k, 10 * k + 10)], "id long, prompt string").coalesce(1).write.mode("append").parquet(folder)
    prompts = spark.readStream.schema("id long, prompt string").option("maxFilesPerTrigger", 1).parquet(folder)
    log = AnswerLog(spark, new_path(spark, "answers"), Counting(str(tmp_path / "asked")))

    def killed(number):
        if number == 1:
            raise RuntimeError("killed after the write, before the commit")

    with pytest.raises(BaseException):
        log.run(prompts, killed)
    assert log.read().count() == 20
    log.run(prompts)
    log.run(prompts)
    got = sorted((r.id, r.answer) for r in log.read().collect())
    assert got == [(i, "Yes" if i % 3 == 0 else "No") for i in range(40)]
    asked = [line for f in (tmp_path / "asked").iterdir() for line in f.read_text().split("\n")]
    assert sorted(asked) == sorted(set(asked)) and len(asked) == 40


def test_nested_mentions_as_by_pairs(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["d", "e", None]), rnd.choice("xy"), i, s := rnd.randrange(30), s + rnd.choice([0, 1, 2, 9, 15])) for i in range(300)]
    rows += rows[:6] + [("d", "x", 900, None, 5), ("d", "x", 901, 3, None), ("d", "x", None, 0, 99)]
    df = spark.createDataFrame(rows, "doc string, chain string, mention int, start int, end int")
    inside = lambda m, o: None not in (m[0], o[0], m[2], o[2], m[3], o[3], m[4], o[4]) and m[:2] == o[:2] and m[2] != o[2] and o[3] <= m[3] and m[4] <= o[4]
    # a mention without an id drops none here
    want = sorted((m for m in rows if not any(inside(m, o) for o in rows)), key=str)
    got = matching.drop_nested(df)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert matching.drop_nested(df.limit(0)).count() == 0


def test_reindexing_sends_a_document_once(spark):
    docs = spark.createDataFrame([("d1", ["a", "b-x", "c", "a"]), ("d2", ["z"]), ("d3", [])], "doc_id string, clean_tokens array<string>")
    mentions = spark.createDataFrame([("d1", "m1", [0], ["b"]), ("d1", "m2", [1], ["a"]), ("d1", "m3", [2], ["none"]), ("d4", "m", [0], ["a"]), ("d3", "m", [0], ["a"])], "doc_id string, m_id string, raw_ids array<int>, tokens array<string>")
    got = matching.reindex_tokens(docs, mentions)
    assert {(r.doc_id, r.m_id): r.tokens_ids for r in got.collect()} == {("d1", "m1"): [1], ("d1", "m2"): [3], ("d1", "m3"): None, ("d3", "m"): None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
    assert matching.reindex_tokens(docs, mentions.where(F.lit(False))).count() == 0


def test_short_words_in_both_cases(spark, tmp_path):
    """The upper case of a sharp s is another word, which must not come onto the list."""
    rows = duckdb.sql("SELECT 1::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, 'ß ß. SS. ss, It it la' AS text")
    rows.write_parquet(f"{tmp_path}/conversations.parquet")
    df = registry.QUERIES["pronoun_tags"](spark, str(tmp_path))
    got = compare.rows(df.columns, [tuple(r) for r in df.collect()])
    r = compare.connect(str(tmp_path)).execute(registry.ORACLES["pronoun_tags"])
    assert got == compare.rows([d[0] for d in r.description], r.fetchall())
