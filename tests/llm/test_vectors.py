"""Vector search against brute force."""

import math

import numpy as np
import pytest
from compare import DATA, connect, rows

from mentionmill.llm import q_vectors, vector_search
from mentionmill.llm.ball_tree import BallTree, top_inner_products
from mentionmill.llm.multi_index_hashing import Codes, MultiIndex, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string, qkey int, shard int, v int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    data = [(int(i), rng.standard_normal(12).astype(np.float32).tolist()) for i in range(1, 900)]
    hot = rng.standard_normal(12).astype(np.float32).tolist()
    data += [(i, hot) for i in range(900, 1200)]  # a quarter are one vector, queries among them
    data += [(1201, None), (1250, [math.nan] * 12), (1300, [0.0] * 12), (1350, []), (1400, [1.0, None] + [0.0] * 10), (None, hot), (1450, [float("inf")] * 12), (1500, [1.0, 2.0])]
    data += [data[3], data[3], data[49]]
    return data, spark.createDataFrame([(i, v, 1, "x", 1, 2, 3) for i, v in data], SCHEMA)


def usable(data, nonzero=False):
    out = {}
    for i, v in data:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v)):
            out[i] = np.array(v, float)
    return out


def brute(data, every, k, score, nonzero=False):
    vs = usable(data, nonzero)
    out = []
    for q in sorted(i for i in vs if i % every == 0):
        s = sorted((score(vs[q], vs[c]), c) for c in vs if c != q and len(vs[c]) == len(vs[q]))[:k]
        out += [(q, r + 1, c, x) for r, (x, c) in enumerate(s)]
    return out


def inner(a, b):
    return -int(sum(int(math.floor(256 * x)) * int(math.floor(256 * y)) for x, y in zip(a, b)))


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 4096), (64, 5)])
def test_exact_top_k(vectors, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(vector_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", block_rows)
    if block_rows < 4096:
        monkeypatch.setattr(vector_search, "BLOCK_BYTES", 1 << 10)
    data, df = vectors
    got = sorted(tuple(r) for r in top_inner_products(df).collect())
    assert got == [(q, r, c, -s) for q, r, c, s in brute(data, 50, 5, inner)]


def test_bounds_of_some_queries_at_a_time(monkeypatch):
    from mentionmill.llm import ball_tree

    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((500, 7)), rng.standard_normal((41, 7))
    whole = ball_tree.kernel(256, 16)(np.arange(500), x, q, [None] * 41, 6)
    monkeypatch.setattr(ball_tree, "AT_ONCE", 4)
    for (a, s), (b, t) in zip(whole, ball_tree.kernel(256, 16)(np.arange(500), x, q, [None] * 41, 6)):
        assert a.tolist() == b.tolist() and s.tolist() == t.tolist()
    for (a, s), v in zip(whole, q):
        want = sorted(((-int(np.floor(256 * x[i]) @ np.floor(256 * v)), i) for i in range(500)))[:6]
        assert list(zip((-s).tolist(), a.tolist())) == want


def test_huge_components(spark):
    data = [(50, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [1.0, 1.0]), (3, [-1e30, 0.0])]
    got = [(r["rank"], r.vec_id) for r in top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in top_inner_products(df).collect()] == [(100, 1, 7)]
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df).collect()] == [(100, 1, 7)]
    for none in (df.limit(0), df.where("vec_id = 100")):
        assert top_inner_products(none).count() == 0 and nearest_neighbours(none).count() == 0


def test_ball_tree_bounds():
    x = np.random.default_rng(1).standard_normal((700, 6))
    t = BallTree(x, 32)
    assert sorted(t.order) == list(range(700))
    for c, r, (a, b) in zip(t.center, t.radius, t.span):
        assert np.sqrt(((x[t.order[a:b]] - c) ** 2).sum(1)).max() <= r + 1e-9


def test_probes_find_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 9), dtype=np.uint8)
    index = MultiIndex(codes)
    for radius in (0, 3, 8, 9, 20, 35, 72):
        for q in (codes[5], rng.integers(0, 256, 9, dtype=np.uint8)):
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


def test_small_balls_are_looked_up():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    codes[1000:] = codes[:2000]
    for flips in range(1, 7):
        codes[flips * 100 : flips * 100 + 50, rng.integers(0, 16, 50)] ^= np.uint8(1 << flips)
    index = MultiIndex(codes)
    for radius in (0, 1, 2, 3, 5, 6):
        for q in codes[[5, 130, 650]]:
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius).tolist()


def hot_vectors():
    """A third of the rows are one vector, many others stand near a few centres."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 64))
    return np.concatenate([x, np.repeat(x[:1], 1500, axis=0)]).astype(np.float32).astype(float)


@pytest.mark.parametrize("table", ["sf0.1/embeddings.parquet", None])
def test_probes_are_lookups_that_miss_few(table):
    """Every probe is a lookup for each value of its balls; what lies within the radius holds nine in ten true neighbours at least."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{DATA}/{table}", columns=["embedding"]).column("embedding").to_pylist(), float) if table else np.unique(hot_vectors(), axis=0)
    model = Codes(np.unique(x[np.random.default_rng(1).permutation(len(x))[:4096]], axis=0), 10, share=min(1, 4096 / len(x)))
    codes = model.encode(x)
    index = MultiIndex(codes)
    assert all(8 <= w <= 16 for w in index.widths) and sum(index.widths) == model.bits
    admitted, found, asked, queries = [], 0, 0, range(0, len(x), len(x) // 100)
    for i in queries:
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        near, rows = np.argsort(dist)[:10], index.within(codes[i], model.radius)
        assert rows.tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[i]).sum(1) <= model.radius).tolist()
        admitted.append(len(rows) / len(x))
        found, asked = found + len(np.intersect1d(near, rows)), asked + 10
    base, more = divmod(model.radius + 1, len(index.widths))
    balls = sum(math.comb(w, j) for i, w in enumerate(index.widths) for j in range(base + (i < more)))
    assert index.lookups == len(queries) * balls
    assert np.mean(admitted) < 0.2 and found >= 0.9 * asked


@pytest.mark.parametrize("hot", [True, False])
def test_recall_beside_a_hot_vector(spark, hot):
    x = hot_vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x if hot else np.unique(x, axis=0))], "vec_id long, embedding array<double>")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    m = np.array([v for _, v in data])
    got = {}
    for r in nearest_neighbours(df, every=100).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = asked = 0
    for q, found in got.items():
        dist = np.sqrt(((m - m[q]) ** 2).sum(1))
        dist[q] = np.inf
        near = np.lexsort((np.arange(len(m)), dist))[:10]
        hit, asked = hit + len(set(found) & set(near.tolist())), asked + 10
    assert len(got) == -(-len(m) // 100) and hit >= 0.9 * asked


def test_one_id_with_two_vectors(spark):
    data = [(100, [1.0, 0.0]), (7, [9.0, 9.0]), (7, [0.5, 0.5]), (8, [2.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for d in (df, df.repartition(3)):
        got = [(r["rank"], r.vec_id, r.score) for r in nearest_neighbours(d).orderBy("rank").collect()]
        assert [x[:2] for x in got] == [(1, 7), (2, 8)] and got[0][2] == math.dist([1, 0], [0.5, 0.5])


def test_lengths_that_the_sample_lacks(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(2 + i % 3).tolist()) for i in range(1, 400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    from mentionmill.llm import vector_search as v
    from mentionmill.llm.multi_index_hashing import kernel

    got = {(r.query_id, r.vec_id) for r in v.search(df, 100, 10, kernel({}), largest=False, score_type="double", nonzero=True).collect()}
    want = {(q, c) for q, _, c, _ in brute(data, 100, 10, math.dist, nonzero=True)}
    assert len(got & want) >= 0.9 * len(want)


def test_codes_follow_the_data():
    x = np.random.default_rng(4).standard_normal((300, 16))
    m = Codes(x, 10)
    assert m.bits % 64 == 0 and 0 < m.radius < m.bits
    assert np.array_equal(m.encode(x), m.encode(x.copy()))


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_nearest_neighbours(vectors, monkeypatch, shard_rows):
    monkeypatch.setattr(vector_search, "SHARD_ROWS", shard_rows)
    data, df = vectors
    vs = usable(data, nonzero=True)
    got = nearest_neighbours(df).collect()
    want = brute(data, 100, 10, lambda a, b: math.dist(a, b), nonzero=True)
    hit = len({(r.query_id, r.vec_id) for r in got} & {(q, c) for q, _, c, _ in want})
    assert hit >= 0.9 * len(want) and len(got) == len(want)
    for r in got:
        assert r.score == pytest.approx(math.dist(vs[r.query_id], vs[r.vec_id]), abs=1e-12)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for v in by.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    # ties among the hot vector's copies go to the smallest ids
    assert [x[2] for x in sorted(by[1000])] == list(range(900, 910))


def test_recall_on_the_driver_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {(r.query_id, r.vec_id) for r in q_vectors.op5_multi_index_hashing(spark, f"{DATA}/sf0.01").collect()}
    want = {(q, c) for q, _, c, _ in brute(data, 100, 10, lambda a, b: math.dist(a, b))}
    assert len(got & want) >= 0.9 * len(want)


def test_top_k_against_sql(spark):
    sf = f"{DATA}/sf0.01"
    df = q_vectors.op3_ball_tree(spark, sf)
    r = connect(sf).execute(q_vectors.SQL3)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


def test_scores_beyond_64_bits_are_ranked_as_they_are():
    from mentionmill.llm import ball_tree

    x, q = np.array([[1e8], [1e9], [1e10], [1e16]]), np.array([[1e16]])
    ids, scores = ball_tree.kernel(256)(np.arange(1, 5), x, q, [None], 2)[0]
    assert ids.tolist() == [4, 3] and scores.tolist() == [2**63 - 1] * 2
