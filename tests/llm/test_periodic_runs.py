"""Periodic runs against brute force and SQL."""

import hashlib

import pytest
from compare import DATA, connect, rows
from hypothesis import given, settings, strategies as st

from mentionmill.llm import periodic_runs as module
from mentionmill.llm.periodic_runs import collapsed, periodic_runs, runs_of
from mentionmill.llm.q_periodic_runs import ORACLES, fold, op13_periodic_runs


def brute(w):
    """Every stretch of every period, the smallest period of each."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in out.items())


@st.composite
def texts(draw):
    kinds = draw(st.sampled_from([1, 2, 3, 7, 40]))
    w = draw(st.lists(st.integers(0, kinds - 1), max_size=90))
    for _ in range(draw(st.integers(0, 3))):
        a, p, size = draw(st.integers(0, 90)), draw(st.integers(1, 12)), draw(st.integers(0, 70))
        for i in range(a + p, min(len(w), a + size)):
            w[i] = w[i - p]
    return [b"%d" % x for x in w]


@settings(max_examples=600, deadline=None)
@given(texts(), st.booleans())
def test_runs_against_brute_force(w, by_period):
    kept, module.TABLE = module.TABLE, 4 if by_period else module.TABLE
    try:
        assert runs_of(w) == brute(w)
    finally:
        module.TABLE = kept


def test_collapsed():
    w = b"x a b a b a b a b a y y y y y y z".split()
    runs = runs_of(w)
    assert runs == [(1, 9, 2), (10, 6, 1)]
    assert b" ".join(collapsed(w, runs)) == b"x a b y z"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    df = op13_periodic_runs(spark, f"{DATA}/{sf}")
    r = connect(f"{DATA}/{sf}").execute(ORACLES["op13_periodic_runs"])
    want = rows([d[0] for d in r.description], r.fetchall())
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == want
    assert sum(x[want[0].index("n_runs")] != "0" for x in want[1]) > 20


def test_awkward_rows(spark, awkward, no_docs):
    got = periodic_runs(awkward, with_runs=True).collect()
    assert len(got) == awkward.count()
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in got}
    for d in (4, 5, 6):
        assert by[d].n_runs == 0 and by[d].start is None and by[d].exponent_milli is None and by[d].runs_sha256 == by[d].collapsed_sha256 == empty
    assert (by[10].start, by[10].length, by[10].period, by[10].exponent_milli) == (0, 32000, 8, 4_000_000)
    assert by[10].collapsed == "alpha beta gamma delta epsilon zeta eta theta" and by[11].collapsed.endswith("theta tail")
    assert by[12].collapsed == "été über señor 日本語 ²" and by[13].collapsed == "a<|endoftext|>b c"
    for r in got:
        assert [tuple(x) for x in r.runs] == brute((dict(awkward.select("doc_id", "text").collect())[r.doc_id] or "").encode().split()) or r.doc_id in (10, 11)
    assert periodic_runs(no_docs).count() == 0
    odd = awkward.select("doc_id", "text").toDF("a.b", "c`d")
    assert sorted(map(str, periodic_runs(odd, "a.b", "c`d").collect())) == sorted(map(str, periodic_runs(awkward).collect()))


def test_long_texts_and_ties():
    w = [b"%d" % (i % 5000) for i in range(60_000)]
    assert runs_of(w) == [(0, 60_000, 5000)]
    w = b"a a a a a a b b b b b b".split()
    assert runs_of(w) == [(0, 6, 1), (6, 6, 1)]


def test_fold():
    w = [b"%d" % i for i in range(50)]
    ids = [d for d in range(200) if fold(d, w) != w]
    assert len(ids) > 5 and all(len(fold(d, w)) == 50 for d in range(200))
    assert fold(None, w) == w and fold(ids[0], []) == []
