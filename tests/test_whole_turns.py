"""Queries on the tokens of turns see whole turns and whole tokens: plain Python on a small table with a long turn."""

from collections import Counter

import pytest
from compare import connect

from mentionmill.plans import q_pairs, registry

#: Tokens that differ only after their third character, and a turn of over 100 tokens.
TURNS = [
    (1, 0, "user", " ".join(f"token{i % 60}" for i in range(130)) + " Last"), (1, 1, "assistant", "alpha beta gamma delta\nepsilon zeta"), (1, 2, "user", "alpha beta token7"),
    (2, 0, "system", "one two three four five"), (2, 1, "user", "one two three four five six"), (2, 2, "assistant", "prefix1 prefix2 prefix3 prefix4 prefix4"),
    (2, 3, "user", "aa1 aa2 aa3 aa4 bb1 bb2 bb3 bb4 cc1 cc2 cc3 cc4 dd1 dd2 dd3 dd4 dd5"), (2, 4, "user", "aa1 aa2 aa3 aa4 bb1 bb2 bb3 bb4 cc1 cc2 cc3 cc4"),
    (5, 0, "user", "same same other same"), (5, 1, "user", ""), (5, 2, "user", "tail end"),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def mentions():
    return [(d, s, i, t) for d, s, _, text in TURNS for i, t in enumerate(text.split())]


def sides():
    m = [(d, s, i, i, t.lower()) for d, s, i, t in mentions()]
    return [x for x in m if x[2] != 1], [(d, s, i, 0 if d % 5 == 0 else start, t) for d, s, i, start, t in m if (d + start) % 4 != 0]


def run(spark, table, name, *cols):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, table).select(*cols).collect())


PLACES = 1 << 32


def test_span_match(spark, table):
    want, (p, g) = [], sides()
    left = {}
    for d, s, i, start, t in g:
        left.setdefault((d, s, start, t), []).append(i)
    for d, s, i, start, t in p:
        if own := left.get((d, s, start, t)):
            want.append((d, s, t, start, s * PLACES + i, s * PLACES + own.pop(0)))
    assert run(spark, table, "span_match", "doc_id", "sent_id", "text", "start", "pred_pos", "gold_pos") == sorted(want) and max(w[3] for w in want) > 100


def test_relaxed_match(spark, table):
    want, (p, g) = [], sides()
    taken = set()
    for d, s, i, start, t in p:
        for h in g:
            if h[:2] != (d, s) or h[:3] in taken:
                continue
            shared = abs(start - h[3]) <= 1
            how = "span" if (t, start) == (h[4], h[3]) else "head" if shared and t == h[4] else "inside" if start == h[3] else None
            if how:
                taken.add(h[:3])
                want.append((d, s, i, h[2], how))
                break
    assert run(spark, table, "relaxed_match", "doc_id", "sent_id", "pred_pos", "gold_pos", "how") == sorted(want) and max(w[2] for w in want) > 100


def test_token_overlap_match(spark, table):
    sets = [(d, s, set(text.lower().split())) for d, s, _, text in TURNS]
    want = []
    for d, s, a in sets:
        fits = [t for e, t, b in sets if e == d and s % 2 == 0 and t % 2 == 1 and len(a & b) > 0.5 * len(b)]
        want += [(d, s, min(fits))] if fits else []
    assert run(spark, table, "token_overlap_match", "doc_id", "pred", "gold") == sorted(want) and want


def pairs():
    m = mentions()
    return [(x, y) for x in m for y in m if x[0] == y[0] and x[1:3] < y[1:3]]


def check_pairs(spark, table, name, rows, keys, want):
    """The operator's pairs one by one, the query's counts and sums of them, and its SQL's."""
    got = sorted((tuple(r[k] for k in keys), r.m1_start, r.m2_start, r.label) for r in rows(spark, table).collect())
    assert got == sorted(want)
    sums = {}
    for key, a, b, label in want:
        n, links, x, y = sums.get(key, (0, 0, 0, 0))
        sums[key] = n + 1, links + label, x + a, y + b
    flat = sorted((*k, *v) for k, v in sums.items())
    names = [*(k.replace("_id", "") if k != "doc_id" else k for k in keys), "n", "links", "m1_starts", "m2_starts"]
    assert run(spark, table, name, *names) == flat
    r = connect(table).execute(registry.ORACLES[name])
    at = [[d[0] for d in r.description].index(n) for n in names]
    assert sorted(tuple(x[i] for i in at) for x in r.fetchall()) == flat


def label(x, y):
    return int(len(x[3]) == len(y[3]))


def test_pairs_within_document(spark, table):
    want = [((x[0], x[1], y[1]), x[2], y[2], label(x, y)) for x, y in pairs()]
    check_pairs(spark, table, "pairs_within_document", q_pairs.within_document, ["doc_id", "m1_sent", "m2_sent"], want)


def test_pairs_adjacent_sentences(spark, table):
    chosen = {(d, s) for d, s, role, _ in TURNS if role != "system"}
    want = [((x[0], x[1], y[1]), x[2], y[2], label(x, y)) for x, y in pairs() if y[1] - x[1] <= 1 and {x[:2], y[:2]} <= chosen]
    check_pairs(spark, table, "pairs_adjacent_sentences", q_pairs.adjacent_sentences, ["doc_id", "m1_sent_id", "m2_sent_id"], want)
    got = q_pairs.adjacent_sentences(spark, table).select("doc_id", "m1_pos", "m2_pos").collect()
    assert Counter(map(tuple, got)) == Counter((d, a * PLACES + i, b * PLACES + j) for (d, a, b), i, j, _ in want)


def test_pairs_sliding_window(spark, table):
    want = []
    for x, y in pairs():
        n = sum(t[0] == x[0] for t in TURNS)
        want += [((x[0], w), x[2], y[2], label(x, y)) for w in range(n - 1) if w <= x[1] and y[1] <= w + 1]
    check_pairs(spark, table, "pairs_sliding_window", q_pairs.sliding_window, ["doc_id", "window"], want)
