"""Overwrite of late arrivals: files against a brute-force layout, byte-identical rest, awkward rows."""

import datetime as dt
import hashlib
import pathlib
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA

from mentionmill.llm import late_overwrite
from mentionmill.llm.late_overwrite import Layout, bloom_filter, held_by, latest
from mentionmill.llm.q_late_overwrite import CUT, FILES, op12_late_overwrite

EPOCH = dt.datetime(1970, 1, 1)
micros = lambda t: "" if t is None else str((t - EPOCH) // dt.timedelta(microseconds=1))
day_of = lambda t: -1 if t is None else (t - EPOCH).days


def brute(rows, cut, per_file):
    """{(day, file_no): rows} of the start and of all rows, and the days to be rewritten."""
    copies = []
    for r in rows:
        h = crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day_of(r["sold_at"]) % 7 == 0:
            copies.append(r | {
                "total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + dt.timedelta(days=h % 2),
                "arrived_at": None if r["arrived_at"] is None else r["arrived_at"] + dt.timedelta(days=1 + h % 97),
            })
    rows = rows + copies
    is_early = lambda r: r["arrived_at"] is not None and r["arrived_at"] < cut

    def kept(some):
        best = {}
        for r in some:
            old = best.get(r["sale_id"])
            if old is None or (r["arrived_at"] or EPOCH) > (old["arrived_at"] or EPOCH):
                best[r["sale_id"]] = r
        return best

    def layout(best):
        out = {}
        for day in {day_of(r["sold_at"]) for r in best.values()}:
            own = sorted((r for r in best.values() if day_of(r["sold_at"]) == day), key=lambda r: (r["sold_at"] or EPOCH, r["sale_id"]))
            for k in range(0, len(own), per_file):
                out[day, k // per_file] = own[k : k + per_file]
        return out

    start, end = kept(filter(is_early, rows)), kept(rows)
    late = [r for r in end.values() if not is_early(r)]
    days = {day_of(r["sold_at"]) for r in late} | {day_of(start[r["sale_id"]]["sold_at"]) for r in late if r["sale_id"] in start}
    return layout(start), layout(end), days


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/sales.parquet").collect()
    rows = [r.asDict() for r in rows]
    start, end, days = brute(rows, dt.datetime.fromisoformat(CUT), 1 + len(rows) // FILES)
    df = op12_late_overwrite(spark, f"{DATA}/{sf}")
    got = {(r.day, r.file_no): r for r in df.collect()}
    assert set(got) == set(end) and len(got) == df.count()
    for key, own in end.items():
        r = got[key]
        assert r.n_rows == len(own)
        assert r.cents == sum(0 if x["total"] is None else int(np.floor(100 * x["total"] + 0.5)) for x in own)
        assert r.rows_crc == sum(crc32(f"{x['sale_id']}:{micros(x['sold_at'])}:{micros(x['arrived_at'])}".encode()) for x in own)
        assert r.ids_sha256 == hashlib.sha256(",".join(str(x["sale_id"]) for x in own).encode()).hexdigest()
        assert r.rewritten == (key[0] in days) and (r.rewritten or start[key] == own)
        assert r.columns == ",".join(rows[0])
    some = next(iter(got.values())).path.replace("file:", "")
    folder = pathlib.Path("/" + some.lstrip("/")).parents[2]
    files = list(folder.rglob("*.parquet"))
    assert {str(f) for f in files} == {"/" + r.path.replace("file:", "").lstrip("/") for r in got.values()}
    for f in files[:: max(1, len(files) // 40)]:
        assert pq.ParquetFile(f).schema_arrow.names == list(rows[0])


SCHEMA = "`sale id` long, day string, file_no string, `a.b` double, at timestamp_ntz, came timestamp_ntz, `q``c` int"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def snapshot(folder):
    root = pathlib.Path(folder.replace("file:", "").replace("//", "/"))
    return {str(f.relative_to(root)): f.read_bytes() for f in root.rglob("*.parquet")}


def test_awkward_rows(spark, tmp_path):
    early = [(1, "x", "y", 1.0, T(1), T(1), 7), (2, "x", "y", None, T(1), T(1), 7), (3, "x", "y", 2.0, T(2), T(2), 7), (4, "x", "y", 2.0, None, T(2), 7), (5, "x", "y", 2.0, T(5), T(5), 7),
             (6, "x", "y", 2.0, T(6), T(6), 7), (8, "x", "y", 2.0, T(5), T(5), 7), (8, "x", "y", 2.0, T(5), T(5), 7), (None, "x", "y", 2.0, T(9), T(9), 7)]
    late = [(3, "x", "y", 9.0, T(4), T(20), 7), (3, "x", "y", 8.0, T(3), T(19), 7), (5, "x", "y", 5.0, T(7), None, 7), (6, "x", "y", 3.0, T(6), T(21), 7), (7, "x", "y", 3.0, T(8), None, 7),
            (None, "x", "y", 3.0, T(10), T(22), 7)]
    df, more = made(spark, early), made(spark, late)
    layout = Layout(df, f"file://{tmp_path}/lay", "sale id", "at", "came", 2)
    layout.write(latest(df, "sale id", "came"))
    before = snapshot(layout.folder)
    assert len(before) == 6
    layout.overwrite(more)
    after = snapshot(layout.folder)
    rows = {(r["sale id"], r[layout.day], r[layout.file]): r["a.b"] for r in layout.read().collect()}
    d = day_of(T(1))
    assert rows == {
        (1, d, 0): 1.0, (2, d, 0): None, (3, d + 3, 0): 9.0, (4, -1, 0): 2.0, (5, d + 4, 0): 2.0, (8, d + 4, 0): 2.0, (6, d + 5, 0): 3.0, (7, d + 7, 0): 3.0, (None, d + 9, 0): 3.0,
    }
    same = {f for f in before if f in after}
    assert {f.split("/")[0] for f in same} == {f"{layout.day}={x}" for x in (d, d + 4, -1)} and all(before[f] == after[f] for f in same)
    assert all(f"{layout.day}={x}/" not in f for f in after for x in (d + 1, d + 8))  # days that lost all their rows
    assert layout.read().select(*[f"`{c.replace('`', '``')}`" for c in df.columns]).schema == df.schema


def test_shorter_days_leave_no_file(spark, tmp_path):
    df = made(spark, [(i, "x", "y", 1.0, T(1), T(1), 7) for i in range(7)])
    layout = Layout(df, f"file://{tmp_path}/lay", "sale id", "at", "came", 2)
    layout.write(df)
    assert len(snapshot(layout.folder)) == 4
    layout.overwrite(made(spark, [(i, "x", "y", 1.0, T(2), T(9), 7) for i in range(5)]))
    assert layout.read().groupBy(layout.day, layout.file).count().orderBy(layout.day, layout.file).collect() == [
        (day_of(T(1)), 0, 2), (day_of(T(2)), 0, 2), (day_of(T(2)), 1, 2), (day_of(T(2)), 2, 1)]


def test_empty_tables(spark, tmp_path):
    none, some = made(spark, []), made(spark, [(1, "x", "y", 1.0, T(1), T(1), 7)])
    for early, late, n in ((none, none, 0), (none, some, 1), (some, none, 1)):
        layout = Layout(early, f"file://{tmp_path}/lay{n}{early is some}", "sale id", "at", "came", 3)
        layout.write(latest(early, "sale id", "came"))
        before = snapshot(layout.folder)
        layout.overwrite(late)
        assert layout.read().count() == n and (late is some or snapshot(layout.folder) == before)


def test_filter_has_no_false_negatives_and_prunes(spark):
    ids = spark.range(0, 40_000, 2)
    bits = bloom_filter(ids, "id")
    assert bits.nbytes == 8 * late_overwrite.WORDS
    from pyspark.sql import functions as F

    found = spark.range(40_000).where(held_by(spark, bits)(F.xxhash64("id")))
    held = found.groupBy((F.col("id") % 2).alias("odd")).count().collect()
    held = {r.odd: r["count"] for r in held}
    assert held[0] == 20_000 and held.get(1, 0) < 200


def test_a_full_filter_changes_nothing(spark, tmp_path):
    """With the smallest filter every row may be late; the result is the same."""
    rows = [(i, "x", "y", 1.0, T(1 + i % 9), T(1), 7) for i in range(300)]
    late = [(i, "x", "y", 2.0, T(1 + i % 4), T(20), 7) for i in range(0, 300, 3)]
    got = []
    for words in (late_overwrite.PIECE, late_overwrite.WORDS):
        layout = Layout(made(spark, rows), f"file://{tmp_path}/w{words}", "sale id", "at", "came", 10)
        layout.write(layout.spark.createDataFrame(made(spark, rows).collect(), SCHEMA))
        layout.overwrite(made(spark, late), words=words)
        got.append(sorted(map(tuple, layout.read().select("`sale id`", "`a.b`", layout.day, layout.file).collect())))
    assert got[0] == got[1] and len(got[0]) == 300
