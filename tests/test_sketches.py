"""Stored sketches: bounds after many merges, rare cases."""

import random

import compare
import duckdb
import pytest

from mentionmill.operators import sketches
from mentionmill.plans import registry
from mentionmill.storage import new_path

SCHEMA = "day int, kind string, counted long, measured double, item string"


def test_bounds_hold_after_merges(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(40), rnd.choice("ab"), rnd.randrange(20_000), rnd.gauss(0, 1), f"i{min(5000, int(rnd.paretovariate(0.6)))}") for _ in range(40_000)]
    path = new_path(spark, "sketches")
    sketches.sketched(spark.createDataFrame(rows, SCHEMA), ["day", "kind"], "counted", "measured", "item").write.parquet(path)
    cells = spark.read.parquet(path)
    assert cells.count() == 80
    whole = sketches.merged(cells, [], [0.1, 0.5, 0.99], 8).collect()
    steps = sketches.merged(cells.repartition(7), ["kind"], [0.5], 8).collect()
    for r, own in [(whole[0], rows)] + [(r, [x for x in rows if x[1] == r.kind]) for r in steps]:
        n = len(own)
        assert r.n == n
        truth = len({x[2] for x in own})
        assert abs(r.distinct - truth) <= sketches.distinct_error() * truth
        values = sorted(x[3] for x in own)
        for q, v in zip([0.1, 0.5, 0.99] if len(r.quantiles) == 3 else [0.5], r.quantiles):
            rank = sum(x < v for x in values) / n
            assert abs(rank - q) <= sketches.quantile_error() + 1 / n
        counts = {}
        for x in own:
            counts[x[4]] = counts.get(x[4], 0) + 1
        slack = n / (0.75 * sketches.MOST_ITEMS)
        assert [h["item"] for h in r.hitters][:2] == sorted(counts, key=counts.get, reverse=True)[:2]
        assert all(abs(h["count"] - counts.get(h["item"], 0)) <= slack for h in r.hitters)
        sizes = cells.selectExpr("max(length(distinct_sketch)) a", "max(length(quantile_sketch)) b").first()
        assert sizes.a < 5000 and sizes.b < 20_000


def test_nulls_and_nothing(spark):
    rows = [(1, "a", None, None, None), (1, "a", None, None, None), (2, "b", 7, 1.5, "x"), (2, None, 7, 2.5, "x"), (3, "b", 8, None, None)]
    cells = sketches.sketched(spark.createDataFrame(rows, SCHEMA), ["day", "kind"], "counted", "measured", "item")
    got = {r.day: r for r in sketches.merged(cells, ["day"], [0.5], 3).collect()}
    assert (got[1].n, got[1].distinct, got[1].quantiles, got[1].hitters) == (2, 0, None, [])
    assert (got[2].n, got[2].distinct, got[2].quantiles) == (2, 1, [1.5]) and [(h["item"], h["count"]) for h in got[2].hitters] == [("x", 2)]
    assert (got[3].distinct, got[3].quantiles) == (1, None)
    assert sketches.merged(cells.limit(0), ["day"], [0.5], 3).count() == 0


def _events(tmp_path, users: int, n: int):
    rows = duckdb.sql(f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i % 40) DAY AS ts, CASE WHEN i % 50 > 0 THEN i % {users} END AS user_id, 'view' AS event_type, (i % 97)::DOUBLE AS value FROM range({n}) t(i)")
    rows.write_parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["sketches_read_again", "sketches_within_their_bounds"])
def test_many_users_none_of_whom_stands_out(spark, tmp_path, name):
    """Distinct users are counted exactly; a type without frequent users still has its row."""
    sf = _events(tmp_path, 7_001, 30_000)
    df = registry.QUERIES[name](spark, sf)
    got = compare.rows(df.columns, [tuple(r) for r in df.collect()])
    r = compare.connect(sf).execute(registry.ORACLES[name])
    assert got == compare.rows([d[0] for d in r.description], r.fetchall())


def test_sets_of_any_numbers(spark):
    rows = [(1, -5), (1, 1 << 40), (2, 1 << 40), (2, 0), (2, None), (3, None)]
    cells = sketches.bitmaps(spark.createDataFrame(rows, "day int, item long"), ["day"], "item")
    assert [tuple(r) for r in sketches.bitmaps_merged(cells, []).collect()] == [(6, 3)]
    assert sorted(tuple(r) for r in sketches.bitmaps_merged(cells, ["day"]).collect()) == [(1, 2, 2), (2, 3, 2), (3, 1, 0)]
