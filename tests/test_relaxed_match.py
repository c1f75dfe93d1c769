"""The greedy match of a sentence's mentions against all pairs looked at one after another."""

import random

from pyspark.sql import functions as F

from mentionmill.operators import matching

DDL = "doc string, sent int, pos int, text string, start int, `end` int, head string, tokens array<int>"


def plain(preds, golds):
    taken, out = set(), []
    for p in sorted(preds, key=lambda r: r[2]):
        for g in sorted(golds, key=lambda r: r[2]):
            if g[2] in taken:
                continue
            shared = bool(set(p[7]) & set(g[7]))
            inside = (p[4] >= g[4] and p[5] <= g[5]) or (g[4] >= p[4] and g[5] <= p[5])
            how = "span" if p[3] == g[3] and p[4] == g[4] else "head" if shared and p[6] == g[6] else "inside" if shared and inside else None
            if how:
                taken.add(g[2])
                out.append((p[0], p[1], p[2], g[2], how))
                break
    return out


def made(rng, doc, sent, n):
    out = []
    for pos in rng.sample(range(5 * n), n):
        start, size = rng.randrange(12), rng.randrange(4)
        tokens = [t for t in range(start, start + size + 1) if rng.random() < 0.8] if rng.random() < 0.9 else []
        out.append((doc, sent, pos, rng.choice("ab"), start, start + size, rng.choice("xyz"), tokens))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    sides = {(d, s): (made(rng, d, s, 25), made(rng, d, s, 20)) for d in ("a", None) for s in range(6)}
    sides["b", 0] = (made(rng, "b", 0, 5), [])
    preds, golds = ([r for both in sides.values() for r in both[k]] for k in (0, 1))
    got = matching.relaxed_match(spark.createDataFrame(preds, DDL), spark.createDataFrame(golds, DDL), ["doc", "sent"]).collect()
    want = [m for p, g in sides.values() for m in plain(p, g)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and {r.how for r in got} == {"span", "head", "inside"}


def test_a_long_sentence_is_not_all_pairs(spark):
    """Before, 30,000 by 30,000 mentions without a common token were looked at one after another."""
    side = lambda shift: spark.range(30000).select(F.lit("d").alias("doc"), F.lit(0).alias("sent"), F.col("id").cast("int").alias("pos"), F.lit("t").alias("text"), (F.col("id") + shift).cast("int").alias("start"), (F.col("id") + shift).cast("int").alias("end"), F.lit("h").alias("head"), F.array((F.col("id") + shift).cast("int")).alias("tokens"))
    assert matching.relaxed_match(side(0), side(29990), ["doc", "sent"]).count() == 10
