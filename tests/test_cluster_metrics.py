"""Clustering metrics against published expectations, and their properties."""

import itertools
import random

import numpy as np
import pytest

from mentionmill.operators.assignment import best_assignment
from mentionmill.operators.cluster_metrics import cluster_scores, dedupe_response, repeats, truncated_percent
from mentionmill.operators import graph
from mentionmill.operators.graph import connected_components



def _f(r, p):
    return r, p, 2 * r * p / (r + p)


A, D, L, M, N = "a bc def", "12345 67 89ABC", "ABC DEFG", "abcdef", "a b c d e f"
#: case: key, response, and expected (recall, precision, F) by metric.
CASES = {
    "A1": (A, "a bc def", {m: (1, 1, 1) for m in ("muc", "b3", "ceafm", "ceafe", "blanc")}),
    "A2": (A, "a de", {"muc": (1 / 3, 1, 0.5), "b3": (7 / 18, 1, 14 / 25), "ceafm": (0.5, 1, 0.66667), "ceafe": (0.6, 0.9, 0.72), "blanc": (0.21591, 1, 0.35385)}),
    "A3": (A, "a bcx defy z", {"muc": (1, 0.6, 0.75), "b3": (1, (4 + 7 / 12) / 9, 110 / 163), "ceafm": (1, 0.66667, 0.8), "ceafe": (0.88571, 0.66429, 0.75918), "blanc": (1, 0.42593, 0.59717)}),
    "A4": (A, "a bcx dy z", {"muc": (1 / 3,) * 3, "b3": _f(5 / 9, 17 / 42), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    "A5": (A, "a bcxB dy z", {"muc": (1 / 3, 1 / 4, 2 / 7), "b3": _f(5 / 9, 5 / 16), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.68889, 0.51667, 0.59048), "blanc": (0.35227, 0.19048, 0.24716)}),
    "A6": (A, "a bcx dy Bz", {"muc": (1 / 3, 1 / 4, 2 / 7), "b3": _f(5 / 9, 17 / 48), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.2087, 0.25817)}),
    "A10": (A, "a b c d e f", {"muc": (0, 0, 0), "b3": (0.5, 1, 2 / 3), "blanc": (0.5, 0.36667, 0.42308)}),
    "A11": (A, "abcdef", {"muc": (1, 0.6, 0.75), "b3": (1, 14 / 36, 14 / 25), "blanc": (0.5, 0.13333, 0.21053)}),
    "A12": (A, "a x y c d e z", {"muc": (0, 0, 0), "b3": _f(13 / 36, 4 / 7), "blanc": (0.22727, 0.11905, 0.15625)}),
    "A13": (A, "axycdez", {"muc": (1 / 3, 1 / 6, 2 / 9), "b3": _f(17 / 36, 6 / 49), "blanc": (0.125, 0.02381, 0.04)}),
    "B1": ("ab cde", "bcx de", {"blanc": (7 / 24,) * 3}),
    "C1": ("ab cde fg", "bcx de fg", {"blanc": (0.5125,) * 3}),
    "D1": (D, "12345 6789ABC", {"muc": (1, 0.9, 18 / 19), "b3": (1, 16 / 21, 32 / 37)}),
    "E1": (D, "1234589ABC 67", {"muc": (1, 0.9, 18 / 19), "b3": (1, 7 / 12, 14 / 19)}),
    "F1": ("ABCD", "AB CD", {"muc": (2 / 3, 1, 0.8)}), "G1": ("AB CD", "ABCD", {"muc": (1, 2 / 3, 0.8)}), "H1": ("ABCD", "ABCD", {"muc": (1, 1, 1)}),
    "J1": ("ABC", "AC", {"muc": (0.5, 1, 2 / 3)}), "K1": ("BCDEGHJ", "ABC DEF GHI", {"muc": (0.5, 0.5, 0.5)}), "L1": (L, "AB CD FGH", {"muc": (0.4, 0.5, 4 / 9)}),
    "M1": (M, "abcdef", {m: (1, 1, 1) for m in ("muc", "b3", "ceafm", "ceafe", "blanc")}), "M2": (M, N, {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "M3": (M, "ab cde f", {"blanc": (0.26667, 1, 0.42105)}), "M4": (M, "abcxyz", {"blanc": (0.2,) * 3}), "M5": (M, "a b c x y z", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "M6": (M, "ab cxy z", {"blanc": (0.06667, 0.25, 0.10526)}), "N1": (N, N, {"muc": (0, 0, 0), "blanc": (1, 1, 1)}), "N2": (N, "abcdef", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    "N3": (N, "ab cde f", {"blanc": (0.73333, 1, 0.84615)}), "N4": (N, "a b c x y z", {"muc": (0, 0, 0), "blanc": (0.2,) * 3}), "N5": (N, "abcxyz", {"blanc": (0, 0, 0)}),
    "N6": (N, "ab cxy z", {"blanc": (0.13333, 0.18182, 0.15385)}),
}


def table(spark, side):
    rows = [(c, m, str(i)) for c, v in CASES.items() for i, chain in enumerate(v[side].split()) for m in chain]
    return spark.createDataFrame(rows, "block string, mention string, chain string")


def test_published_cases(spark):
    key, resp = table(spark, 0), table(spark, 1)
    blocks = key.select("block").distinct().withColumnRenamed("block", "case").selectExpr("case as block", "case")
    got = {r["case"]: r for r in cluster_scores(key, resp, ["case"], blocks).collect()}
    assert set(got) == set(CASES)
    for case, (_, _, want) in CASES.items():
        for metric, values in want.items():
            assert [got[case][f"{metric}_{x}"] for x in "rpf"] == pytest.approx(values, abs=1e-4), (case, metric)


def test_perfect_and_relabelled(spark):
    key = table(spark, 0)
    other = key.selectExpr("block", "mention", "concat('z', chain) as chain")
    r = cluster_scores(key, other).first()
    assert r.conll_f == pytest.approx(1) and r.blanc_f == pytest.approx(1)


def test_repeated_mentions(spark):
    resp = spark.createDataFrame([("d", "a", "1", 0), ("d", "a", "2", 1), ("d", "b", "2", 2)], "block string, mention string, chain string, pos int")
    assert sorted((r.mention, r.chain) for r in dedupe_response(resp).collect()) == [("a", "1"), ("b", "2")]
    assert repeats(resp).first().n_repeats == 1
    with pytest.raises(Exception, match="too many repeated"):
        repeats(resp, most=0).collect()


def test_truncated(spark):
    assert spark.createDataFrame([(0.66667,)], "x double").select(truncated_percent("x")).first()[0] == 66.66


def test_assignment_is_best():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (4, 4)]:
        w = rng.integers(0, 9, (n, m)).astype(float)
        pairs, total = best_assignment(w)
        k = min(n, m)
        best = max(sum(w[i, j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k) for b in itertools.combinations(range(m), k))
        assert total == best and len({i for i, _ in pairs}) == len(pairs) == k
    assert best_assignment(np.zeros((0, 3))) == ([], 0.0)


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(200, 260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {x: find(x) for x in root}
    empty = spark.createDataFrame([(None, 1)], "src long, dst long")
    assert connected_components(empty).count() == 0


def plain_components(edges):
    root = {}
    for a, b in edges:
        if a is not None and b is not None:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_components_by_rounds(spark, monkeypatch):
    """With too many edges for one task: chains, hubs at either end of the order, loops, nulls, repeats, strings."""
    monkeypatch.setattr(graph, "HELD", 3)
    edges = [(i, i + 1) for i in range(40, 70)] + [(500, i) for i in range(100, 160)] + [(0, i) for i in range(1, 30)]
    edges += [(200, 200), (None, 3), (4, None), (40, 41), (300, 299), (299, 298), (298, 297)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect())
    assert got == plain_components(edges)
    names = [(f"n{a}", f"n{b}") for a, b in edges if a is not None and b is not None]
    assert dict(connected_components(spark.createDataFrame(names, "src string, dst string")).collect()) == plain_components(names)


def test_hubs_are_split(spark, monkeypatch):
    """The joins of the rounds read a hub's edges in several tasks."""
    from mentionmill.storage import Scratch

    plans, table = [], Scratch.table

    def recorded(self, df, name, *more):
        if name.startswith("large"):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name, *more)

    monkeypatch.setattr(Scratch, "table", recorded)
    monkeypatch.setattr(graph, "HELD", 3)
    conf = {
        "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "4k",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(f"spark.sql.{k}", None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        edges = spark.range(1, 40_000, 1, 8).selectExpr("if(id % 10 < 7, 0, id - id % 10) as src", "id as dst")
        got = connected_components(edges).where("component = 0").count()
    finally:
        for k, v in old.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert got > 28_000 and any("skew=true" in p for p in plans)


def test_sparse_assignment_equals_dense():
    import numpy as np

    from mentionmill.operators.assignment import best_assignment, best_cells

    rng = np.random.default_rng(4)
    for _ in range(400):
        n, m = rng.integers(1, 9, 2)
        w = np.where(rng.random((n, m)) < rng.choice([0.3, 0.7, 1.0]), rng.integers(1, 6, (n, m)) / rng.choice([1.0, 7.0]), 0)
        u, v = np.nonzero(w)
        assert best_cells(u, v, w[u, v]) == pytest.approx(best_assignment(w)[1])
    assert best_cells(np.array([], int), np.array([], int), np.array([])) == 0


def test_assignments_of_linked_chains(spark):
    """Components that are no stars, stars and single cells, over two blocks, against all permutations."""
    import random
    from itertools import permutations

    from mentionmill.operators.cluster_metrics import ceaf_sums

    rnd = random.Random(3)
    key = [(b, i, f"k{rnd.randrange(5)}") for b in (1, 2) for i in range(30)] + [(3, 1, "a"), (3, 2, "a"), (4, 1, "x")]
    resp = [(b, i, f"r{rnd.randrange(4)}") for b in (1, 2) for i in range(3, 33)] + [(3, 1, "p"), (3, 2, "q"), (4, 9, "y")]
    got = {r.block: (r.ceafm_num, r.ceafe_num) for r in ceaf_sums(*(spark.createDataFrame(x, "block long, mention long, chain string") for x in (key, resp))).collect()}
    for b in (1, 2, 3):
        ks, rs = ({}, {})
        for d, side in ((ks, key), (rs, resp)):
            for blk, i, c in side:
                if blk == b:
                    d.setdefault(c, set()).add(i)
        wide = list(rs.values()) + [set()] * len(ks)
        for at, f in ((0, lambda x, y: len(x & y)), (1, lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x and y else 0)):
            best = max(sum(f(x, y) for x, y in zip(ks.values(), p)) for p in permutations(wide, len(ks))) if len(wide) < 8 else None
            if best is None:  # more rows than permutations can take: by subsets
                from functools import cache

                chains, others = list(ks.values()), list(rs.values())

                @cache
                def solve(i, used):
                    if i == len(chains):
                        return 0
                    return max([solve(i + 1, used)] + [f(chains[i], others[j]) + solve(i + 1, used | 1 << j) for j in range(len(others)) if not used >> j & 1])

                best = solve(0, 0)
            assert got[b][at] == pytest.approx(best)
    assert 4 not in got


def plain_linkage(names, p, threshold):
    groups = [[n] for n in names]
    while len(groups) > 1:
        d, x, y = min(
            (round(1 - sum(p.get(frozenset((i, j)), 0.0) for i in groups[x] for j in groups[y]) / (len(groups[x]) * len(groups[y])), 12), x, y)
            for x in range(len(groups)) for y in range(x + 1, len(groups))
        )
        if d >= threshold:
            break
        groups[x] += groups.pop(y)
    return {n: min(g) for g in groups for n in g}


def test_average_linkage_of_sparse_pairs(spark):
    import random

    from mentionmill.operators.scoring import average_linkage

    rnd = random.Random(9)
    rows = [(b, i, j, rnd.random()) for b in (1, 2) for i in range(14) for j in range(i + 1, 14) if rnd.random() < 0.6]
    rows += [(3, 0, 1, 0.0), (3, 1, 2, 0.8), (3, 0, 2, 0.8)]
    got = {}
    for r in average_linkage(spark.createDataFrame(rows, "block long, a long, b long, p double"), [0.7, 0.3, 0.5]).collect():
        got.setdefault((r.block, r.threshold), {})[r.mention] = r.cluster
    for (b, th), clusters in got.items():
        p = {frozenset((x, y)): v for blk, x, y, v in rows if blk == b}
        assert clusters == plain_linkage(sorted({m for pair in p for m in pair}), p, th)
    assert len(got) == 9


def test_triangles_at_hubs(spark, monkeypatch):
    """Neighbours of few and of many links give the same counts as sets."""
    import random

    from mentionmill.operators import scoring

    rnd = random.Random(5)
    pairs = [(b, i, j, rnd.choice([True, True, False, None]) if i else True) for b in (1, 2) for i in range(15) for j in range(i + 1, 15) if not i or rnd.random() < 0.5]
    df = spark.createDataFrame(pairs, "block long, a long, b long, pred boolean")
    near = {}
    for b, i, j, p in pairs:
        if p:
            near.setdefault((b, i), set()).add(j)
            near.setdefault((b, j), set()).add(i)
    want = sorted((b, i, j, len(near.get((b, i), set()) & near.get((b, j), set())), len((near.get((b, i), set()) ^ near.get((b, j), set())) - {i, j})) for b, i, j, _ in pairs)
    for light in (0, 4, 128):
        monkeypatch.setattr(scoring, "LIGHT", light)
        got = sorted((r.block, r.a, r.b, r.both, r.one) for r in scoring.neighbour_counts(df).collect())
        assert got == want


def test_thresholds_at_once(spark):
    from mentionmill.operators import scoring
    from mentionmill.operators.cluster_metrics import cluster_scores

    scored = spark.createDataFrame([(1, i, j, ((i * 7 + j * 3) % 10) / 10) for i in range(8) for j in range(i + 1, 8)], "block long, a long, b long, score double")
    gold = spark.createDataFrame([(1, i, f"c{i % 3}") for i in range(8)], "block long, mention long, chain string")
    got = {r.threshold: r.conll_f for r in scoring.sweep_cluster_thresholds(scored, gold, [0.3, 0.6, 0.9]).collect()}
    for t, f in got.items():
        resp = scoring.cluster(scored, t).select("block", "mention", scoring.F.col("cluster").cast("string").alias("chain"))
        assert f == pytest.approx(cluster_scores(gold, resp).first().conll_f)
    assert len(got) == 3
