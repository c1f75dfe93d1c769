"""Quality: held-out accuracy, word vectors against plain sums, awkward rows."""

import numpy as np
import pytest
from compare import DATA

from mentionmill.llm import q_quality, quality


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = q_quality.op11_quality(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    clean, junk = held[held.quality == 1], held[held.quality == 0]
    assert len(clean) > 60 and len(junk) > 12
    assert clean.predicted.mean() > 0.97 and junk.predicted.mean() < 0.15
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    # calibrated: the mean score is near the share of clean documents
    assert abs(held.score.mean() - held.quality.mean()) < 0.08


def plain_units(text):
    out = []
    for w in (text or "").encode().split():
        kinds = bytes(quality._KIND[c] for c in w)
        out.append((w.lower(), bytes(c for i, c in enumerate(kinds) if i < 2 or not (c == kinds[i - 1] == kinds[i - 2]))))
    return [(w, f, i > 0 and w == out[i - 1][0]) for i, (w, f) in enumerate(out)]


TEXTS = ["The the THE!! cat*** sat", "", None, "a  b\tc\n| d", "word", "Été über 99 999 9999", "a a a b"]


def test_units_are_the_words():
    content, form, at = quality.units(TEXTS)
    flat = [u for t in TEXTS for u in plain_units(t)]
    assert np.diff(at).tolist() == [len(plain_units(t)) for t in TEXTS] and len(flat) == len(content)
    by_word, by_form = {}, {}
    for (w, f, again), c, s in zip(flat, content, form):
        assert by_word.setdefault(w, c) == c and by_form.setdefault((f, again), s) == s
    assert len(set(by_form.values())) == len(by_form)


def test_word_vectors_are_sums_of_their_contexts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = quality.word_vectors(docs)
    index = quality.index_vectors()
    sums = np.zeros((quality.UNITS, quality.DIM))

    def add(unit, other):
        for d in index[other]:
            sums[unit, d % quality.DIM] += 1 if d < quality.DIM else -1

    for t in TEXTS:
        content, form, _ = quality.units([t])
        for i in range(len(content)):
            add(content[i], form[i])
            for j in range(max(0, i - 2), min(len(content), i + 3)):
                if i != j:
                    add(content[i], content[j])
                    add(form[i], form[j])
    for part, mine in ((sums[: quality.CONTENTS], got[: quality.CONTENTS]), (sums[quality.CONTENTS :], got[quality.CONTENTS :])):
        some = part.any(1)
        unit = part[some] / np.linalg.norm(part[some], axis=1)[:, None]
        unit -= unit.mean(0)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        assert np.abs(mine[some] / 4096 - unit).max() < 1e-3 and not mine[~some].any()


def test_scores_do_not_depend_on_other_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = q_quality.train(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    texts = TEXTS + [r.text for r in docs.select("text").limit(60).collect()]
    whole = model.score(texts)
    for size in (1, 7):
        assert np.array_equal(np.concatenate([model.score(texts[i : i + size]) for i in range(0, len(texts), size)]), whole)


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 1), (3, 0), (4, 0), (9, None), (None, 1), (7, 0), (10, 1)], "doc_id long, quality int")
    model = quality.learn(awkward, awkward, labels)
    assert model.net is not None
    got = quality.score(awkward, model, keep=["doc_id", "source", "v"], into="found").collect()
    assert len(got) == awkward.count() and all(0 <= r.found.score <= 1 for r in got)
    by = {r.doc_id: r.found.score for r in got}
    assert by[4] == by[5] == by[6]
    assert quality.score(no_docs, model).count() == 0
    odd = awkward.select("doc_id", "text").toDF("a.b", "c`d")
    assert quality.learn(odd, odd, labels.toDF("a.b", "q.l"), id_col="a.b", text_col="c`d", label_col="q.l").net is not None
    assert quality.score(odd, model, "a.b", "c`d").columns == ["a.b", "score"]


@pytest.mark.parametrize("label,score", [(1, 1.0), (0, 0.0), (None, 0.0)])
def test_one_class_or_none(spark, awkward, label, score):
    labels = spark.createDataFrame([(d, label) for d in range(5)], "doc_id long, quality int")
    model = quality.learn(awkward, awkward, labels)
    assert {r.score for r in quality.score(awkward, model).collect()} == {score}


def test_temperature_finds_the_least_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.temperature(z * 5, y) - 5) < 0.6
    assert 0.8 < quality.temperature(z, y) < 1.25
