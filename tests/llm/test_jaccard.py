"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
from compare import DATA, connect, rows

from mentionmill.llm import jaccard_join, q_jaccard
from mentionmill.llm.jaccard_join import band_shape, bands, dense_sketches, forest, jaccard_components, segment_keys, slack


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs, k=3, pct=90):
    """(shingle counts, component of each id) by comparing all pairs."""
    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = {d: d for d in sets}
    ids = [d for d in sets if d is not None]
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= pct * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= (comp[a], comp[b]) != (m, m)
            comp[a] = comp[b] = m
    return sets, comp


def test_awkward_rows(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    sets, comp = brute(docs)
    got = jaccard_components(awkward).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id][0])
        assert r.component_id == (0 if r.doc_id is None else comp[r.doc_id]), r.doc_id
    by = {r.doc_id: r.component_id for r in got}
    assert by[8] == 7 and by[4] == 4 and by[6] == 6


def test_no_rows(spark, no_docs):
    assert jaccard_components(no_docs).count() == 0


def family(seed, n, words, edits):
    rnd = random.Random(seed)
    base = [f"t{rnd.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(30)}"
        out.append(" ".join(w))
    return out


def test_families_of_near_copies(spark):
    """Many members at similarities on both sides of the threshold; chains; repeats."""
    texts = family(1, 60, 150, 5) + family(2, 40, 60, 3) + family(3, 30, 14, 1) + family(4, 8, 3000, 160) + family(5, 10, 9, 1)
    docs = list(enumerate(texts + texts[:9]))
    sets, comp = brute(docs)
    got = {r.doc_id: r for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r.component_id for d, r in got.items()} == comp
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s[0]) for d, s in sets.items()}
    assert 20 < len(set(comp.values())) < len(docs)


def test_other_parameters(spark):
    docs = list(enumerate(family(6, 40, 40, 6)))
    for k, pct in ((5, 80), (1, 60)):
        got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k=k, pct=pct).collect()}
        assert got == brute(docs, k, pct)[1]


def test_linked_sets_share_a_segment():
    """Pigeonhole: at the largest difference allowed, some joined key is equal in every band."""
    rng = np.random.default_rng(5)
    lows = bands(90, 5000)
    for n in (9, 10, 11, 13, 20, 57, 150, 800, 3000):
        for _ in range(20):
            m = min(int(n / 0.9), n + int(rng.integers(0, n // 9 + 1)))
            b = int(np.searchsorted(lows, n, "right")) - 1
            delta = slack(n + m, 90)
            lost = (delta - (m - n)) // 2
            common = rng.integers(0, 2**63, n - lost, dtype=np.int64).astype(np.uint64)
            x = np.unique(np.concatenate([common, rng.integers(0, 2**63, lost, dtype=np.int64).astype(np.uint64)]))
            y = np.unique(np.concatenate([common, rng.integers(0, 2**63, m - (n - lost), dtype=np.int64).astype(np.uint64)]))
            if 100 * len(common) < 90 * (len(x) + len(y) - len(common)):
                continue
            shape = band_shape(lows[b], lows[b + 1], 90)
            assert set(segment_keys(x, b, *shape).tolist()) & set(segment_keys(y, b, *shape).tolist())


def test_dense_sketch_is_a_lower_bound():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**62, n, dtype=np.int64).astype(np.uint64)) for n in (1, 5, 80, 300)]
    sets.append(sets[3][:290])
    s = dense_sketches(sets)
    for i in range(len(sets)):
        for j in range(len(sets)):
            assert np.bitwise_count(s[i] ^ s[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
    assert forest([7, 8], [sets[3], sets[4]], 90) == [(7, 8)]


def test_against_sql(spark):
    sf = f"{DATA}/sf0.001"
    df = q_jaccard.op2_jaccard_join(spark, sf)
    r = connect(sf).execute(q_jaccard.SQL)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


def thue_morse(n):
    """Words that a polynomial modulo 2**64 cannot tell apart."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate({97: "b", 98: "a"})


def test_periodic_words_are_told_apart(spark):
    docs = list(enumerate(w for n in (64, 256, 1024, 4096) for w in thue_morse(n)))
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_families_of_several_blocks(spark, monkeypatch):
    """Blocks of a few texts: rounds, keys of different components, block pairs."""
    texts = family(1, 60, 150, 5) + family(2, 40, 60, 3) + family(7, 25, 40, 9)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {pct: brute(docs, 3, pct)[1] for pct in (90, 80)}
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    for turns, pct in ((0, 90), (2, 90), (1, 80)):
        monkeypatch.setattr(jaccard_join, "TURNS", turns)
        got = {r.doc_id: r.component_id for r in jaccard_components(df, pct=pct).collect()}
        assert got == want[pct]


def test_no_text_has_an_empty_segments_key():
    """Random sets of all sizes keep only keys of segments that hold something."""
    rng = np.random.default_rng(8)
    lows = bands(80, 3000)
    for n in (*range(lows[0], 40), 100, 900, 2500):
        seen = {}
        for i in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            b = int(np.searchsorted(lows, n, "right")) - 1
            for c in (b, b - 1):
                if c >= 0:
                    for key in segment_keys(x, c, *band_shape(lows[c], lows[c + 1], 80)).tolist():
                        assert seen.setdefault((c, key), i) == i


def test_filter_lets_all_ids_through(spark):
    ids = [-(2**63), -5, 0, 3, 10**15, 2**63 - 1, *range(100, 3000, 7)]
    may = jaccard_join._May(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    import pyarrow as pa

    got = may(pa.array([*ids, None, *range(10**6, 10**6 + 2000)], pa.int64()))
    assert got[: len(ids)].all() and not got[len(ids)] and got[len(ids) + 1 :].sum() < 20


def test_many_classes_are_joined_without_the_filter(spark, monkeypatch):
    docs = list(enumerate(family(6, 40, 40, 6)))
    monkeypatch.setattr(jaccard_join._May, "MOST", 0)
    monkeypatch.setattr(jaccard_join, "HELD", 100)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k=5, pct=80).collect()}
    assert got == brute(docs, 5, 80)[1]


def test_ids_with_several_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(5, one), (5, two), (3, two), (4, one), (9, three), (9, three)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 9), (9, 9)]
