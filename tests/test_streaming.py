"""Streams: chains that grow, joins by time, restarts, and state that goes."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mentionmill.operators.scoring import cluster
from mentionmill.storage import new_path
from mentionmill.streaming import joins, scoring
from mentionmill.streaming.chains import _contracted, growing_chains, settled, state_in_rocksdb
from mentionmill.streaming.runs import Closing, Output

T0 = dt.datetime(2024, 1, 1)
PAIRS = "block string, a long, b long, score double, at timestamp"


def pairs(seed=3):
    rnd, out = random.Random(seed), []
    for block in ("x", "y", None):
        for _ in range(60):
            a, b = rnd.randrange(40), rnd.randrange(40)
            score = rnd.choice([None, float("nan"), 0.2, 0.5, 0.9])
            out.append((block, a, b, score, T0 + dt.timedelta(minutes=rnd.randrange(50))))
    return out


def table(df):
    return sorted(map(str, df.select("block", "mention", "cluster").collect()))


def test_chains_of_batches_out_of_order_equal_one_batch(spark):
    rows = pairs()
    whole = spark.createDataFrame(rows, PAIRS)
    random.Random(1).shuffle(rows)
    folder, out = new_path(spark, "arriving"), Output(spark, "chains")

    def arrive(some):
        for k in range(0, len(some), 25):  # a file each
            spark.createDataFrame(some[k : k + 25], PAIRS).coalesce(1).write.mode("append").parquet(folder)

    arrive(rows[:80])
    end = Closing(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder), "at")
    df = growing_chains(end.rows, 0.5)
    with state_in_rocksdb(spark):
        out.append(df)
        early = settled(out.read())
        assert table(early) == table(cluster(spark.createDataFrame(rows[:80], PAIRS).withColumn("score", F.nanvl("score", F.lit(None))), 0.5))
        arrive(rows[80:])
        out.append(df)  # started again from the checkpoint
        want = table(cluster(whole.withColumn("score", F.nanvl("score", F.lit(None))), 0.5))
        assert out.read().where("final").count() == 0 and table(settled(out.read())) == want
        assert out.progress[-1].stateOperators[0].numRowsTotal > 100
        end.close(lambda: out.append(df))
    assert table(out.read().where("final")) == want  # every mention once
    assert out.progress[-1].stateOperators[0].numRowsTotal == 0  # finished blocks hold no state


def test_tasks_contract_their_predictions():
    """A row or so for each mention of a block and time, with the same chains; rows without both ends are one."""
    kinds = [("block", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("at", pa.timestamp("us", "UTC"))]
    at = [T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(minutes=k) for k in range(3)]
    rows = [(block, a, b, 0.9 if a % 3 == b % 3 else 0.1, at[k]) for block in ("x", None) for k in (0, 1) for a in range(30) for b in range(a + k, 30)]
    rows += [("x", 1, None, 0.9, at[2]), ("x", None, None, 0.9, at[0]), ("y", 5, 5, 0.9, at[0])]
    batch = pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
    got = [tuple(r.values()) for b in _contracted(0.5)([batch]) for r in b.to_pylist()]
    assert [r for r in got if r[1] is None] == [(None, None, None, float("-inf"), at[2])] and len(got) == 2 + 4 * 27
    assert {(r[0], r[4], r[1], r[2]) for r in got if r[1] is not None} == {(b, t, m, m % 3) for b in ("x", None) for t in at[:2] for m in range(3, 30)} | {("y", at[0], 5, 5)}


def test_finished_blocks_go_and_late_rows_change_nothing(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    folder, out = new_path(spark, "arriving"), Output(spark, "chains")
    put = lambda rows: spark.createDataFrame(rows, PAIRS).coalesce(1).write.mode("append").parquet(folder)
    put([("old", 2, 1, 1.0, hour(0)), ("old", 3, 4, 0.0, hour(1))])
    df = growing_chains(spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", 1).parquet(folder), 0.5)
    with state_in_rocksdb(spark):
        out.append(df)
        for rows in ([("new", 8, 9, 1.0, hour(20))], [("new", 9, 10, 1.0, hour(21))], [("old", 1, 3, 1.0, hour(1)), ("new", 11, 8, 0.9, hour(22))]):
            put(rows)
            out.append(df)
    got = out.read()
    assert sorted(map(tuple, got.where("final").collect())) == [("old", 1, 1, True), ("old", 2, 1, True), ("old", 3, 3, True), ("old", 4, 4, True)]
    assert sorted(map(tuple, settled(got.where("block = 'new'")).collect())) == [("new", m, 8) for m in (8, 9, 10, 11)]


EVENTS = "event_id long, user_id long, ts timestamp"


def events(hot=False):
    rnd, out = random.Random(8), []
    for i in range(400):
        user = 1 if hot and i % 3 == 0 else rnd.choice([2, 3, 4, None])
        out.append((i, user, None if rnd.random() < 0.03 else T0 + dt.timedelta(seconds=rnd.randrange(0, 400_000, 10))))
    return out + out[:5]


def brute(left, right, bound, outer):
    out = []
    for i, u, t in left:
        near = [j for j, v, s in right if u is not None and u == v and t and s and 0 <= (s - t).total_seconds() <= bound]
        out += [(i, j) for j in near] or ([(i, None)] if outer else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("outer", [False, True])
def test_tables_within_a_bound(spark, outer):
    rows = events(hot=True)
    left, right = rows[:250] + rows[400:], rows[150:400] + rows[150:153]
    got = joins.within(spark.createDataFrame(left, EVENTS), spark.createDataFrame(right, EVENTS), "user_id", "ts", 3600, outer)
    assert sorted(((r.l_event_id, r.r_event_id) for r in got.collect()), key=str) == brute(left, right, 3600, outer)
    none = spark.createDataFrame([], EVENTS)
    assert joins.within(none, spark.createDataFrame(right, EVENTS), "user_id", "ts", 3600, outer).count() == 0
    assert joins.within(spark.createDataFrame(left, EVENTS), none, "user_id", "ts", 3600, outer).count() == (len(left) if outer else 0)


def test_a_hot_user_is_split_by_time(spark):
    """The join's keys are user and bucket: no key holds a user's whole history."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), (F.lit(str(T0)).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    got = joins.within(rows, rows, "user_id", "ts", 600)
    assert got.count() == sum(min(11, n - i) for i in range(n))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_at" in plan and "_own" in plan


@pytest.mark.parametrize("outer", [False, True])
def test_streams_within_a_bound_drop_their_state(spark, outer):
    rows = sorted((e for e in events() if e[2] is not None), key=lambda e: e[2])
    left, right = new_path(spark, "left"), new_path(spark, "right")
    put = lambda some, folder: spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    views, buys = rows[::2], rows[1::2]
    for folder in (left, right):
        put([], folder)
    ends = [Closing(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(p), "ts", user_id=-1, event_id=-1) for p in (left, right)]
    out = Output(spark, "within")
    df = joins.stream_within(*[e.rows for e in ends], "user_id", "ts", 3600, "2 hours", outer)
    for k in range(4):  # each a quarter of the time, the stream started anew
        for some, folder in ((views, left), (buys, right)):
            put(some[k * len(some) // 4 : (k + 1) * len(some) // 4], folder)
        out.append(df)
    held = [p.stateOperators[0].numRowsTotal for p in out.progress if p.stateOperators]
    assert max(held) < len(rows) * 0.7  # not all that came is kept
    for at in range(2):
        for e in ends:
            e._write(("2200-01-01", "2200-01-02")[at])
        out.append(df)
    got = sorted(((r.l_event_id, r.r_event_id) for r in out.read().where("l_event_id >= 0").collect()), key=str)
    assert got == brute(views, buys, 3600, outer)
    assert out.progress[-1].stateOperators[0].numRowsTotal <= 4  # the closing rows


def test_updates_survive_a_restart(spark):
    folder, out = new_path(spark, "arriving"), Output(spark, "counts")
    put = lambda rows: spark.createDataFrame(rows, "k string, label int, pred int").coalesce(1).write.mode("append").parquet(folder)
    put([("a", 1, 1), ("a", 1, 0), ("b", 0, 1)])
    df = scoring.running_confusion(spark.readStream.schema("k string, label int, pred int").parquet(folder), ["k"])
    out.update(df)
    put([("a", 1, 1), ("c", 0, None)])
    out.update(df)
    got = {r.k: (r.tp, r.fn, r.fp, r.n_invalid) for r in out.latest(["k"]).collect()}
    assert got == {"a": (2, 1, 0, 0), "b": (0, 0, 1, 0), "c": (0, 0, 0, 1)}
