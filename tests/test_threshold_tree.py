"""Cluster metrics at every threshold: merges against solving anew, forests against plain Kruskal, tables against copies per threshold."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mentionmill.operators import graph, scoring
from mentionmill.operators.assignment import best_cells
from mentionmill.operators.threshold_tree import best_cluster_threshold, cluster_metrics_by_threshold, unit_changes


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


@st.composite
def units(draw):
    n, chains = draw(st.integers(1, 13)), draw(st.integers(1, 5))
    chain = {i: c for i in range(n) if (c := draw(st.integers(0, chains)))}
    size = {c: sum(x == c for x in chain.values()) + draw(st.sampled_from([0, 0, 1, 4])) for c in range(1, chains + 1)}
    places = draw(st.sampled_from([1, 3]))
    edges = [(i, j, round(draw(st.floats(0, 1)), places)) for i in range(n) for j in range(i) if draw(st.booleans())]
    return n, chain, size, edges


@settings(max_examples=400, deadline=None)
@given(units())
def test_changes_add_up_to_solving_anew(unit):
    n, chain, size, edges = unit
    u, v, s = (np.array([e[k] for e in edges], float if k == 2 else int) for k in range(3))
    forest = [edges[k] for k in graph.heaviest(u, v, s)] if edges else []
    total = np.zeros(6)
    for score, *change in unit_changes([(i, c, size[c]) for i, c in chain.items()], forest):
        total += change
        clusters = {}
        for i, r in enumerate(components(n, [(a, b) for a, b, x in edges if score is not None and x >= score])):
            clusters.setdefault(r, []).append(i)
        cells = [(r, c, k, len(own)) for r, own in clusters.items() for c in size if (k := sum(chain.get(i) == c for i in own))]
        phi = np.array([2 * k / (size[c] + m) for _, c, k, m in cells])
        best = best_cells(np.array([x[0] for x in cells]), np.array([x[1] for x in cells]), phi) if cells else 0.0
        links = n - len(clusters)
        want = [sum(k - 1 for _, _, k, _ in cells), links, sum(k * k / size[c] for _, c, k, _ in cells), sum(k * k / m for *_, k, m in cells), best, -links]
        assert np.allclose(total, want, atol=1e-9)


def rows(seed, blocks, n, places):
    rnd = random.Random(seed)
    scored, gold = [], []
    for b in range(blocks):
        for i in range(n):
            if rnd.random() < 0.9:
                gold.append((b, i, f"g{rnd.randrange(4)}"))
            for j in range(i):
                if rnd.random() < 0.5:
                    scored.append((b, i, j, None if rnd.random() < 0.05 else round(rnd.random(), places)))
    scored += [(0, 1, 1, 0.5), (0, 2, 0, float("nan")), scored[0], (scored[1][0], scored[1][2], scored[1][1], scored[1][3]), (99, 5, 6, 0.25)]
    gold += [gold[0], (77, 1, "only"), (99, 5, "g1")]
    return scored, gold


def frames(spark, scored, gold):
    return spark.createDataFrame(scored, "block int, a long, b long, score double"), spark.createDataFrame(gold, "block int, mention long, chain string")


def test_every_threshold_equals_clustering_anew(spark):
    scored, gold = frames(spark, *rows(1, 4, 12, 1))
    got = {r.threshold: r.conll_f for r in cluster_metrics_by_threshold(scored, gold).collect()}
    want = scoring.sweep_cluster_thresholds(scored.withColumn("score", scoring.F.nanvl("score", scoring.F.lit(None))), gold, sorted(got)).collect()
    assert len(got) == len(want) > 8
    for r in want:
        assert got[r.threshold] == pytest.approx(r.conll_f, abs=1e-9)
    best = best_cluster_threshold(scored, gold).collect()
    top = max(round(f, 12) for f in got.values())
    assert [(r.threshold, round(r.conll_f, 12)) for r in best] == [(min(t for t, f in got.items() if round(f, 12) == top), top)]


def test_empty_tables(spark):
    scored, gold = frames(spark, *rows(1, 1, 6, 1))
    assert cluster_metrics_by_threshold(scored.limit(0), gold).count() == best_cluster_threshold(scored.limit(0), gold).count() == 0
    got = cluster_metrics_by_threshold(scored, gold.limit(0)).collect()
    assert got and {r.conll_f for r in got} == {0.0}


@pytest.mark.parametrize("held", [1 << 20, 40])
def test_spanning_forest(spark, monkeypatch, held):
    """Components at every score are those of all edges, and a forest has no more edges than they need; with rounds too."""
    monkeypatch.setattr(graph, "HELD", held)
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300), round(rnd.random(), 2)) for _ in range(2500)]
    df = spark.createDataFrame([*edges, (None, 1, 0.5), (7, 7, 0.9), (1, 2, None)], "u long, v long, score double").repartition(7)
    forest = [tuple(r) for r in graph.spanning_forest(df).collect()]
    assert len(forest) == 300 - len(set(components(300, [e[:2] for e in edges])))
    same = lambda a: {frozenset(i for i, r in enumerate(a) if r == x) for x in set(a)}
    for t in [k / 20 for k in range(21)]:
        assert same(components(300, [e[:2] for e in edges if e[2] >= t])) == same(components(300, [e[:2] for e in forest if e[2] >= t]))


def test_a_large_unit_takes_time_in_proportion_to_its_merges():
    """Twice the mentions of one unit take no more than about twice the time, with long chains and all scores different."""
    import time

    def seconds(n):
        rnd = random.Random(2)
        edges = sorted(((i, rnd.randrange(max(0, i - 50), i), rnd.random()) for i in range(1, n)), key=lambda e: -e[2])
        began = time.process_time()
        assert sum(1 for _ in unit_changes([(i, 1 + i // 20, 20) for i in range(n)], edges)) == n
        return time.process_time() - began

    small, large = seconds(5_000), seconds(20_000)
    assert large < 10 * small


@pytest.mark.parametrize("share, seed", [(1.0, 1), (0.5, 2), (0.05, 3)])
def test_thinned_pairs_decide_every_threshold(spark, share, seed):
    """Before, every pair was joined with the numbers of its mentions and shuffled."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from mentionmill.operators import threshold_tree

    rng = random.Random(seed)
    rows = [(1, i, j, rng.choice([rng.random(), rng.choice([0.1, 0.25, 0.35, 0.9]), float("nan")])) for i in range(60) for j in range(i) if rng.random() < share]
    rows += [(1, 100, 101, float("nan"))]
    t = pa.table(dict(zip(("block", "a", "b", "score"), map(list, zip(*rows)))))
    few = threshold_tree.thinned(t, "a", "b", "score", 0.1)
    assert len(few) < len(t) or share < 0.1
    ddl = "block long, a long, b long, score double"
    gold = spark.createDataFrame([(1, i, f"c{i % 4}") for i in range(0, 60)] + [(1, 100, "c1")], "block long, mention long, chain string")
    got, want = (sorted(tuple(round(x, 9) for x in r) for r in threshold_tree.cluster_metrics_by_threshold(spark.createDataFrame([tuple(r.values()) for r in x.to_pylist()], ddl).withColumn("score", F.round("score", 1)), gold).collect()) for x in (few, t))
    assert got == want and len(got) >= 9
