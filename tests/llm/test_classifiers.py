"""Language identification and toxicity: held-out accuracy and awkward rows."""

import numpy as np
import pytest
from compare import DATA

from mentionmill.llm import language_id, q_language, q_toxicity, texthash, toxicity


def brute_language(train, texts):
    """Naive Bayes counted with dictionaries over the same normalised n-grams."""
    import math
    from collections import Counter

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = "   " + " ".join(s.split()) + "   "
        return [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1) if s[i : i + n].strip()]

    counts = {}
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(grams(t))
    vocab = {g for c in counts.values() for g in c}
    out = []
    for t in texts:
        score = {lang: sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(vocab))) for g in grams(t)) for lang, c in counts.items()}
        out.append(max(sorted(score), key=score.get))
    return out


def test_language_agrees_with_plain_counts(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang").toPandas()
    model = q_language.train(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    held = docs[docs.doc_id % 5 == 0]
    some = [t for t in held.text if len(t) > 200][:25]
    train = [(t, x) for t, x in zip(docs.text, docs.lang) if x]
    assert model.predict(some)[0] == brute_language(train, some)


def test_language_held_out(spark):
    sf = f"{DATA}/sf0.01"
    got = q_language.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_awkward(spark, awkward, no_docs):
    model = language_id.learn(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["en", "fr"]
    got = language_id.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (4, 5, 6, 14))
    assert all(by[d].lang_pred in ("en", "fr") and 0 < by[d].score <= 1 for d in (7, 10, 12, None))
    assert language_id.identify(no_docs, model).count() == 0
    kept = language_id.identify(awkward, model, keep=["doc_id", "text", "source", "v"])
    assert kept.columns == ["doc_id", "text", "source", "v", "lang_pred", "score"] and kept.count() == awkward.count()


def test_language_without_labels(spark, awkward, no_docs):
    model = language_id.learn(no_docs)
    got = language_id.identify(awkward, model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_grams_do_not_cross_texts():
    a, at, letters = language_id.grams(["ab cd", "", None, "é"])
    b, bt, _ = language_id.grams(["é"])
    assert a[at[3] : at[4]].tolist() == b[bt[0] : bt[1]].tolist()
    assert letters.tolist() == [4, 0, 0, 1]
    one = language_id.grams(["x!!--y"])[0]
    assert one.tolist() == language_id.grams(["x y"])[0].tolist()


def plain_grams(text):
    """Buckets of one text's n-grams by plain string work, each position's in order."""
    out = []
    for part in language_id.parts_of(text):
        s = "".join(c if c.isalpha() else " " for c in part.lower())
        s = " " + " ".join(s.split()) + "   " if s.strip() else "   "
        for i in range(len(s) - 3):
            row = []
            for n in language_id.ORDERS:
                h = n * 0x2545F4914F6CDD1D
                for j in range(n):
                    h += ord(s[i + j]) * int(language_id._MULT[j])
                h &= (1 << 64) - 1
                h ^= h >> 30
                h = h * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                h ^= h >> 27
                h = h * 0x94D049BB133111EB & (1 << 64) - 1
                row.append((h ^ h >> 31) >> 48)
            out.append(row)
    return out


SHORT = ["a", "der Mann", "the cat", "xyz q", "", None, "!!", "é!", "¿señor?", "x1y2z3", "  gap  ", "ok...", "日本", "I am", "je", "no, no", "A.B.C", "'tis", "ça va", "-"]


def test_grams_are_the_texts_own():
    """Each text's n-grams, at every place of a batch, by plain string work."""
    for texts in (SHORT, SHORT[::-1], SHORT * 7):
        b, at, _ = language_id.grams(texts)
        for i, t in enumerate(texts):
            assert b[at[i] : at[i + 1]].tolist() == plain_grams(t or ""), t


def test_scores_do_not_depend_on_other_rows(spark):
    """Bit-equal scores in batches of 1, 7 and 2000 rows, and the plain sum of the model's log probabilities."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = q_language.train(docs)
    texts = SHORT + [r.text for r in docs.select("text").collect()]
    texts += [t[: 1 + i % 20] for i, t in enumerate(texts) if t][:400]
    whole = model.judge(texts)
    for size in (1, 7, 2000):
        parts = [model.judge(texts[i : i + size]) for i in range(0, len(texts), size)]
        assert [x for p in parts for x in p[0]] == whole[0]
        for k in (1, 2):
            assert np.array_equal(np.concatenate([p[k] for p in parts]), whole[k])
    for t, lang, score in [(t, a, b) for t, a, b in zip(texts, *whole[:2]) if t and len(t) <= 20]:
        total = np.array([sum(int(model.logp[g, j]) for row in plain_grams(t) for g in row) / (1 << 20) for j in range(len(model.langs))]) + model.prior
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0)
            continue
        p = np.exp(total - total.max())
        assert lang == model.langs[int(total.argmax())] and score == pytest.approx((p / p.sum()).max(), abs=1e-12)


def test_languages_are_counted_by_parts(monkeypatch, spark):
    """Long texts in parts, flushed counts, more languages than are scored at once; equal to plain counts."""
    monkeypatch.setattr(language_id, "PART", 50)
    monkeypatch.setattr(language_id, "HELD", 200)
    monkeypatch.setattr(language_id, "AT_ONCE", 4)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "x" * 70]
    rows = [(i, " ".join(words[(i * 7 + j) % 6] + "abcdefghijk"[i % 11] for j in range(30)), f"l{i % 11}") for i in range(44)]
    # in this process only: the changed sizes are not known to worker processes
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = np.zeros((language_id.BUCKETS, 11))
    monkeypatch.setattr(language_id, "PART", 1 << 16)
    for _, t, lang in rows:
        for row in plain_grams(t):
            for g in row:
                counts[g, int(lang[1:])] += 1
    want = language_id.NaiveBayes([f"l{i}" for i in range(11)], counts[:, :], np.full(11, 4.0))
    order = [want.langs.index(x) for x in model.langs]
    assert np.array_equal(model.logp, want.logp[:, order])
    monkeypatch.setattr(language_id, "PART", 50)
    got = model.judge([t for _, t, _ in rows])
    assert got[0] == [x for _, _, x in rows]


def test_a_very_long_text(spark):
    """50 MB in bounded memory."""
    import tracemalloc

    model = language_id.learn(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")], "doc_id long, text string, lang string"))
    text = "the dog and a cat " * 2_800_000
    tracemalloc.start()
    langs, score, _ = model.judge([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert langs == ["en"] and score[0] > 0.99 and peak < 600e6


def test_kept_columns_may_have_any_name(spark, awkward):
    """``score`` is a column of the table too."""
    model = language_id.learn(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "doc_id long, text string, lang string"))
    got = language_id.identify(awkward, model, keep=awkward.columns)
    assert got.columns == [c for c in awkward.columns if c != "score"] + ["lang_pred", "score"]
    got = language_id.identify(awkward, model, keep=awkward.columns, into="x")
    assert got.columns == [*awkward.columns, "x"] and {r.score for r in got.collect()} == {0.5}


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    rows = [(i, "the cat" if i % 2 else "le chat", "en" if i % 2 else "fr") for i in range(40)] + [(None, "the", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for q in (q_language.op4_language_id, q_toxicity.op9_toxicity):
        got = {r.doc_id: r.held_out for r in q(spark, str(tmp_path)).collect()}
        assert got[None] is False and set(got.values()) == {True, False}


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    m = toxicity.Boosted(x[:1000], y[:1000])
    assert ((m.score(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    knots, values = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1.0]))
    assert (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1 and len(knots) == len(values)
    one = toxicity.Boosted(x[:50], np.zeros(50))
    assert np.isfinite(one.score(x)).all()


def test_features():
    words = toxicity._FIXED
    f = toxicity.features(["you idiot", "an id1ot here", "IDIOT!!!", None, "fine words"], words, np.empty(0, np.int64))
    assert f.shape == (5, toxicity.FEATURES) and np.isfinite(f).all()
    assert f[0, 0] == 0.5 and f[0, 7] > 0 and f[1, 0] == 0 and f[1, 4] > 0 and f[2, 1] > 0 and f[2, 9] == 1 and f[2, 11] > 0
    assert not f[3].any() and f[4, 0] == 0


def test_toxicity_held_out(spark):
    sf = f"{DATA}/sf0.1"
    got = q_toxicity.op9_toxicity(spark, sf)
    known = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = known[known.held_out]
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.predicted == 1).mean() < 0.005 and (toxic.predicted == 1).mean() > 0.85
    assert got.count() == 10_000


def test_toxicity_awkward(spark, awkward, no_docs):
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "fine day ") * (1 + i % 5)) for i in range(80)] + [(None, "x"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (None, 1), (99, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(awkward, model).collect()}
    assert len(got) == len({r.doc_id for r in awkward.collect()}) and all(0 <= s <= 1 for s in got.values())
    probe = spark.createDataFrame([(1, "you idiot"), (2, "fine day"), (3, "")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert s[1] > 0.7 > s[2] and s[3] < 0.7
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(probe, nothing).collect()} == {0.0}


def test_fit_does_not_depend_on_row_order(spark):
    docs = spark.createDataFrame([(i, ("you moron " if i % 3 == 0 else "nice ") * (1 + i % 4)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    a = toxicity.learn(docs, labels).score(["you moron", "nice", ""])
    b = toxicity.learn(docs.orderBy("text").repartition(3), labels.repartition(2)).score(["you moron", "nice", ""])
    assert a == pytest.approx(b)


def plain_features(text, words, stems):
    """The features of one text by plain string work; ``words`` and ``stems`` are sets of the model's keys."""
    import math

    data = (text or "").encode("utf-8", "surrogatepass")
    alpha = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    space, digit, upper = (lambda c: c in b" \t\n\v\f\r"), (lambda c: 48 <= c <= 57), (lambda c: 65 <= c <= 90)
    lower = lambda c: c + 32 if upper(c) else c
    leet = {ord(k): ord(v) for k, v in toxicity.SWAPS.items()}
    key = lambda w: int(np.uint64(texthash.span_hashes(texthash.Lanes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0]).view(np.int64))
    split = lambda keep, read: bytes(read(c) for c in data if alpha(c) or space(c) or keep(c)).split()
    own = split(lambda c: False, lower)
    seen = {}
    is_word = lambda w: seen.setdefault(w, key(w) in words)
    hit = [is_word(w) for w in own]
    stem = [any(len(w) > n and int.from_bytes(w[:n], "little") | n << 48 in stems for n in (4, 5, 6)) for w in own]
    second = [w in {x.encode() for x in toxicity.SECOND} for w in own]
    bad = [a or b for a, b in zip(hit, stem)]
    where = [i for i, x in enumerate(second) if x]
    gaps = [min((abs(i - j) for j in where), default=10**9) for i, x in enumerate(bad) if x]
    close = sum(1 / (1 + g) for g in gaps if g <= toxicity.NEAR)
    swapped = sum(map(is_word, split(lambda c: c in leet, lambda c: leet.get(c, lower(c)))))
    masked, n = max(swapped - sum(hit), 0), len(own)
    letters, size = sum(map(alpha, data)), max(len(data), 1)
    mark = [not alpha(c) and not space(c) and not digit(c) for c in data]
    inner = sum(mark[i] and alpha(data[i - 1]) and alpha(data[i + 1]) for i in range(1, len(data) - 1))
    run = sum(mark[i] and data[i] == data[i - 1] == data[i - 2] for i in range(2, len(data)))
    shouted = sum(upper(a) and upper(b) for a, b in zip(data, data[1:]))
    some, bads, l1 = max(n, 1), sum(bad), max(letters, 1)
    return [
        sum(hit) / some, math.log1p(sum(hit)), bads / some, math.log1p(bads), masked / some, math.log1p(masked), sum(second) / some, close / max(bads, 1), math.log1p(close),
        sum(map(upper, data)) / l1, shouted / l1, data.count(b"!") / size, data.count(b"?") / size, sum(mark) / size, sum(map(digit, data)) / size, inner / size, run / size, math.log1p(n),
    ]


def plain_score(model, text):
    """One text's score by walking every tree and reading the calibration between its knots."""
    import bisect

    x = plain_features(text, set(model.words.tolist()), set(model.stems.tolist()))
    total = model.model.base
    for splits, leaf in model.model.trees:
        node = 0
        for feature, cut in splits:
            f = int(feature[node])
            node = 2 * node + (bisect.bisect_left(model.model.edges[f].tolist(), x[f]) > cut[node])
        total += leaf[node]
    knots, values = model.knots.tolist(), model.values.tolist()
    i = bisect.bisect_right(knots, total)
    if i == 0 or i == len(knots):
        return values[0] if i == 0 else values[-1]
    a, b = knots[i - 1], knots[i]
    return values[i - 1] + (values[i] - values[i - 1]) * (total - a) / (b - a)


def test_toxicity_by_plain_python(spark):
    """Every score of the query on a whole table, by features and trees worked out one by one."""
    sf = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = q_toxicity.train(docs, labels)
    got = {r.doc_id: r for r in q_toxicity.op9_toxicity(spark, sf).collect()}
    for r in docs.collect():
        assert got[r.doc_id].score == pytest.approx(plain_score(model, r.text), abs=1e-9), r.doc_id
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)
    for t in ["you idiot", "an id1ot here", "IDIOT!!! you", "", None, "a.b c@d !!!", "Tú, IDIOTA", "st0p it $cum"]:
        assert toxicity.features([t, "x y"], model.words, model.stems)[0] == pytest.approx(plain_features(t, set(model.words.tolist()), set(model.stems.tolist())))


def test_scores_of_toxicity_do_not_depend_on_other_rows(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q_toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = [r.text for r in docs.select("text").collect()] + ["you idiot", "", None]
    whole = model.score(texts)
    for size in (1, 7):
        assert np.array_equal(np.concatenate([model.score(texts[i : i + size]) for i in range(0, len(texts), size)]), whole)
