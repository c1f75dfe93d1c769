"""Operators on small fixtures: metrics, scores, matching, text, sources."""

import pytest
from pyspark.sql import functions as F

from mentionmill.functions import text, vectors
from mentionmill.operators import filters, matching, metrics, pairs, predictors, scoring
from mentionmill.sources import annotated, conll, predictions


def test_metrics_of_published_confusions(spark):
    """70 pairs, 6 positive: (tp, fp) and the published accuracy, AUC, precision, recall, F1."""
    want = {
        (4, 5): (0.9, 0.7943, 0.4444, 0.6667, 0.5333), (3, 9): (0.8286, 0.6797, 0.25, 0.5, 0.3333), (3, 3): (0.9143, 0.7266, 0.5, 0.5, 0.5),
        (3, 14): (0.7571, 0.6406, 0.1765, 0.5, 0.2609), (3, 33): (0.4857, 0.4922, 0.0833, 0.5, 0.1429), (2, 15): (0.7286, 0.5495, 0.1176, 0.3333, 0.1739),
        (3, 4): (0.9, 0.7188, 0.4286, 0.5, 0.4615), (1, 0): (0.9286, 0.5833, 1.0, 0.1667, 0.2857),
    }
    rows = [(tp, fp, 6 - tp, 64 - fp) for tp, fp in want]
    got = metrics.with_scores(spark.createDataFrame(rows, "tp long, fp long, fn long, tn long")).collect()
    for r in got:
        assert [round(r[c], 4) for c in ("acc", "auc", "precision", "recall", "f1")] == pytest.approx(want[r.tp, r.fp], abs=1e-4)


def test_metrics_with_nulls_and_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1)], "label int, pred int")
    r = metrics.binary_metrics(df).first()
    assert (r.tp, r.fn, r.n_invalid, r.auc) == (1, 1, 2, None)
    empty = metrics.binary_metrics(df.limit(0)).first()
    assert empty.tp == 0 and empty.acc is None and empty.f1 == 0


def test_ties_and_missing_votes(spark):
    df = spark.createDataFrame([(1, 1, 2), (0, 1, 2), (1, 0, 0)], "label int, correct int, valid int")
    got = df.select(metrics.correct_share_to_class("label", "correct", "valid"), metrics.correct_share_to_class("label", "correct", "valid", "wrong"), metrics.yes_share_to_class("correct", "valid")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (0, 1, 1), (None, None, 0)]


def test_toy_graph(spark):
    rows = [("d", "a", "b", True), ("d", "a", "c", True), ("d", "b", "c", True), ("d", "c", "d", False), ("d", "d", "e", None)]
    p = spark.createDataFrame(rows, "block string, a string, b string, pred boolean")
    s = {(r.a, r.b): (r.both, r.one, r.score) for r in scoring.score_votes(p).collect()}
    assert s["a", "b"] == (1, 0, 3.0) and s["c", "d"] == (0, 2, -4.0) and s["d", "e"] == (0, 0, 0.0)
    c = {r.mention: r.cluster for r in scoring.cluster(scoring.score_votes(p), 1.0).collect()}
    assert c == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    adj = {r.m: r.neighbours for r in scoring.adjacency(p).collect()}
    assert adj["a"] == ["b", "c"] and adj["e"] == []


def test_average_linkage(spark):
    p = spark.createDataFrame([("d", 1, 2, 0.9), ("d", 1, 3, 0.2), ("d", 2, 3, 0.6), ("d", 3, 4, 0.1)], "block string, a long, b long, p double")
    got = {(r.threshold, r.mention): r.cluster for r in scoring.average_linkage(p, [0.3, 0.7]).collect()}
    assert [got[0.3, m] for m in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert [got[0.7, m] for m in (1, 2, 3, 4)] == [1, 1, 1, 4]
    with pytest.raises(Exception, match="more than"):
        scoring.average_linkage(p, [0.3], most=2).collect()


def test_cluster_threshold_sweep(spark):
    p = spark.createDataFrame([("d", 1, 2, 0.9), ("d", 2, 3, 0.4), ("d", 3, 4, 0.8)], "block string, a long, b long, score double")
    gold = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y"), ("d", 4, "y")], "block string, mention long, chain string")
    sweep = scoring.sweep_cluster_thresholds(p, gold, [0.3, 0.5, 0.95])
    best = scoring.best_of(sweep, "conll_f").first()
    assert best.threshold == 0.5 and best.conll_f == pytest.approx(1)


def test_windows_count_pairs_once_for_each_window(spark):
    s = spark.createDataFrame([("d", i) for i in range(3)] + [("one", 0)], "doc_id string, sent_id int")
    m = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 2, 3), ("one", 0, 1), ("one", 0, 2)], "doc_id string, sent_id int, pos int")
    got = pairs.sliding_window(pairs.with_sentence_ordinal(m, s), s)
    n = {(r.doc_id, r.m1_pos, r.m2_pos): r["count"] for r in got.groupBy("doc_id", "m1_pos", "m2_pos").count().collect()}
    assert n == {("d", 1, 2): 2, ("d", 1, 3): 1, ("d", 2, 3): 1, ("one", 1, 2): 1}


def test_scopes_with_null_distance(spark):
    p = spark.createDataFrame([("wd", 0), ("wd", 3), ("cd", None)], "scope string, seq int")
    got = {s: p.where(pairs.scope_filter(s)).count() for s in pairs.SCOPES}
    assert got == {"2s": 1, "wd-": 1, "wd+": 2, "cd-": 1, "cd+": 3}


def test_relaxed_match_takes_each_gold_once(spark):
    cols = "s int, pos int, text string, start int, `end` int, head string, tokens array<int>"
    pred = spark.createDataFrame([(1, 0, "the cat", 0, 1, "cat", [0, 1]), (1, 1, "cat", 1, 1, "cat", [1]), (1, 2, "dog", 5, 5, "dog", [5])], cols)
    gold = spark.createDataFrame([(1, 0, "cat", 1, 1, "cat", [1]), (1, 1, "big dog run", 4, 6, "run", [4, 5, 6])], cols)
    got = sorted((r.pred_pos, r.gold_pos, r.how) for r in matching.relaxed_match(pred, gold, ["s"]).collect())
    assert got == [(0, 0, "head"), (2, 1, "inside")]


def test_nearest_entity_skips_touching_and_places(spark):
    ev = spark.createDataFrame([(1, 10, 5, 6)], "s int, mention int, start int, `end` int")
    en = spark.createDataFrame([(1, 1, 0, 3, "HUM", 0), (1, 2, 4, 5, "HUM", 1), (1, 3, 4, 4, "LOC", 2), (1, 4, 8, 9, "HUM", 3)], "s int, mention int, start int, `end` int, type string, pos int")
    left = matching.nearest_entity(ev, en, ["s"], True).first()
    right = matching.nearest_entity(ev, en, ["s"], False).first()
    assert (left.entity, left.distance, right.entity, right.distance) == (1, 2, 4, 2)


def test_reindex(spark):
    docs = spark.createDataFrame([("d", ["x", "Malibu", ",", "Calif.", "y"])], "doc_id string, clean_tokens array<string>")
    m = spark.createDataFrame([("d", "1", [5, 6, 7], ["Malibu", ",", "Calif"]), ("d", "2", [9], ["nowhere"])], "doc_id string, m_id string, raw_ids array<int>, tokens array<string>")
    got = {r.m_id: r.tokens_ids for r in matching.reindex_tokens(docs, m).collect()}
    assert got == {"1": [1, 2, 3], "2": None}


def test_mixing_needs_equal_pairs(spark):
    a = spark.createDataFrame([(1, "wd", 0, 1)], "k int, scope string, seq int, pred int")
    with pytest.raises(Exception, match="different pairs"):
        matching.mixed_experiments(a, a, a.withColumn("k", F.lit(2)), ["k"]).collect()


def test_mixing_of_equal_pairs_joins_nothing(spark):
    """The same rows as a join by pairs gives, without one; a join where the classes of the experiments differ."""
    rows = [(k, ("wd", "cd", None)[k % 3], (None, 0, 1, 2, 7)[k % 5]) for k in range(60)]
    near, wd, cd = (spark.createDataFrame([(*r, r[0] * 10 + i if r[0] % 7 else None) for r in rows], "k int, scope string, seq int, pred int").repartition(i + 1) for i in range(3))
    got = matching.mixed_experiments(near, wd, cd, ["k"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    joined = matching.mixed_experiments(near, wd.drop("scope", "seq"), cd, ["k"])
    other = matching.mixed_experiments(near, wd.withColumn("seq", F.lit(0)), cd, ["k"])
    assert all("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in (joined, other))
    assert got.dtypes == joined.dtypes
    for df in (got, other):
        assert sorted(map(str, df.collect())) == sorted(map(str, joined.collect()))
    with pytest.raises(Exception, match="different pairs"):
        matching.mixed_experiments(near, wd.where("k > 0"), cd, ["k"]).collect()


def test_text(spark):
    df = spark.createDataFrame([("He said `` ca n't '' at 5 p. m. ( ok ) .",)], "t string")
    assert df.select(text.untokenize("t")).first()[0] == "He said \"ca n't\" at 5 p.m. (ok)".replace("ca n't", "can't") + "."
    s = spark.createDataFrame([(["A", "cat", ",", "here"],)], "w array<string>")
    assert s.select(text.sentence_context("w")).first()[0] == " A cat, here."
    d = spark.createDataFrame([("{'tokens': 'a', 'tokens_ids': [1], 'm_id': '3', 'cluster_id': 7}\n{'tokens': 'b', 'tokens_ids': [2, 3], 'm_id': '4', 'cluster_id': 7}",)], "t string")
    assert [(r.tokens, r.tokens_ids) for r in d.select(text.parse_pair_dicts("t")).first()[0]] == [("a", [1]), ("b", [2, 3])]
    chat = spark.createDataFrame([("Q: x?\nA: yes\nQ: y?",)], "t string").select(text.chat_messages("t")).first()[0]
    assert [(m.role, m.content) for m in chat] == [("user", "x?"), ("assistant", "yes"), ("user", "y?")]
    f = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(text.fuzzy_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in f] == [75, None]
    v = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(vectors.cosine("a", "b")).collect()] == [-1.0, None]
    assert v.select(vectors.similarity("a", "b")).first()[0] == 0.0
    p = spark.createDataFrame([("He", "NN"), ("car", "NN")], "m string, t string")
    assert [r[0] for r in p.select(text.pronoun_override("t", "m", ["he"])).collect()] == ["PRON", "NN"]


XML = """<Document doc_name="1_1ecb.xml"><token t_id="1" sentence="0" number="0">He</token><token t_id="2" sentence="0" number="1">ran</token>
<token t_id="3" sentence="1" number="0">Home</token><Markables><HUMAN_PART_PER m_id="5"><token_anchor t_id="1"/></HUMAN_PART_PER>
<ACTION_OCCURRENCE m_id="6"><token_anchor t_id="2"/></ACTION_OCCURRENCE><ACTION_OCCURRENCE m_id="9" RELATED_TO="" TAG_DESCRIPTOR="run" instance_id="ACT1"/></Markables>
<Relations><CROSS_DOC_COREF r_id="7" note="ACT1"><source m_id="6"/><target m_id="9"/></CROSS_DOC_COREF></Relations></Document>"""


def test_annotated_xml(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "1_1ecb.xml").write_text(XML)
    (tmp_path / "1" / "1_2ecbplus.xml").write_text("<broken")
    files = annotated.scan_files(spark, str(tmp_path))
    t = annotated.tables(annotated.parse_annotations(files))
    assert t["tokens"].count() == 3 and t["errors"].first().doc_id == "1_2ecbplus"
    m = {r.m_id: r for r in annotated.mentions_of(t["markables"], t["tokens"], t["relations"]).collect()}
    assert set(m) == {"5", "6"}
    assert (m["6"].coref_chain, m["6"].mention_type, m["6"].is_singleton) == ("ACT1", "ACT", False)
    assert (m["5"].coref_chain, m["5"].tokens_str, m["5"].is_continuous) == ("Singleton_HUM_5_1_1ecb", "He", True)
    docs = {r.doc_id: r for r in annotated.corpus_documents(files).collect()}
    assert docs["1_2ecbplus"].topic_id == "1_ecbplus" and docs["1_2ecbplus"].is_plus
    bad = spark.createDataFrame([("1_1ecb", 2)], "doc_id string, t_id int")
    clean = [r.token for r in annotated.clean_tokens(t["tokens"], bad).orderBy("t_id").collect()]
    assert clean == ["He [EOS]", "Home"]


def test_small_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("d\t0\t1\tcat\t-\n\nd\t0\t2\t\tdog\tA1\n")
    got = [(r.token, r.chain) for r in annotated.read_token_table(spark, str(tmp_path / "t.tsv")).orderBy("number").collect()]
    assert got == [("cat", "-"), ("dog", "A1")]
    (tmp_path / "s.csv").write_text("topic,file,sentence\n36,1ecb.xml,2\n")
    assert tuple(annotated.read_selected(spark, str(tmp_path / "s.csv")).first()) == ("36_1ecb", 2)
    (tmp_path / "w.txt").write_text("He\nshe\n\nhe\n")
    assert sorted(r.word for r in annotated.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["he", "she"]
    (tmp_path / "v.txt").write_text("cat 0.5 1.0\n")
    assert annotated.read_vectors(spark, str(tmp_path / "v.txt")).first().vector == [0.5, 1.0]


def test_conll_round_trip(spark, tmp_path):
    (tmp_path / "k.txt").write_text("#begin document (x); part 000\nx\t0\ta\t(1)\nx\t1\tb\t(2|(3\nx\t2\tc\t2)|3)\nx\t3\td\t-\n#end document\n")
    got = sorted((r.doc, r.begin, r.end, r.chain) for r in conll.read_conll(spark, str(tmp_path / "k.txt")).collect())
    assert got == [("x", 0, 0, "1"), ("x", 1, 2, "2"), ("x", 1, 2, "3")]
    m = spark.createDataFrame([("1_ecb", "1_1ecb", 0, 0, 1, "A"), ("1_ecb", "1_1ecb", 0, 3, 2, None), ("1_ecb", "1_1ecb", 1, 0, 3, "A")], "topic_id string, doc_id string, sent_id int, start int, mention int, chain string")
    lines = conll.conll_lines(m)
    conll.write_conll(lines, str(tmp_path / "out"))
    back = conll.read_conll(spark, str(tmp_path / "out"))
    assert sorted((r.begin, r.chain) for r in back.collect()) == [(0, "0"), (1, "1"), (2, "1")]
    raw = spark.read.text(str(tmp_path / "k.txt")).selectExpr("'k' as file", "1 as line", "value")
    assert conll.document_index(raw).first().doc == "x" and conll.one_token_mentions(raw).count() == 1


def test_prediction_tables(spark, tmp_path):
    (tmp_path / "m_35-10ecb_shot0(ecb)_beam1_noSample(t0r1)[p1-p2].csv").write_text('Prompt 1,Prompt 2,text,label\n"[1, 1]","[0, 1]","a\nb",1.0\nPrompt 1,Prompt 2,text,label\n"[0, 0]","[1, 1]",c,0\n,,,\n')
    rows = predictions.read_predictions_v1(spark, str(tmp_path / "m*"))
    got = sorted((r.prompt, r.yes, r.valid, r.label) for r in rows.collect())
    assert got == [(1, 0, 0, 0), (1, 1, 1, 1), (2, 0, 1, 1), (2, 1, 1, 0)]
    assert predictions.normalise_v1(rows, "m").columns == ["model", "prompt", "yes", "valid", "label"]
    files = predictions.folder(spark, str(tmp_path))
    s = files.select(predictions.settings("name").alias("s")).first().s
    assert (s.model, s.data, s.shots, s.temperature, s.prompts) == ("m", "35-10ecb", "0", "0", "p1-p2")
    assert predictions.without_partner(files, files).count() == 0
    (tmp_path / "v2.csv").write_text('topic,m1_str,wd/cd,seq,label,13SAU\n36,a,wd,0,1,"[2, 3, 4]"\n')
    r = predictions.read_predictions_v2(spark, str(tmp_path / "v2.csv"), "13SAU").first()
    assert (r.correct, r.valid, r.repeat, r.scope, r.label) == (2, 3, 4, "wd", 1)
    log = spark.createDataFrame([(1, "p")], "n int, prompt string")
    assert predictions.prompt_log(log).first().value == "1##############\np"
    predictions.write_pairs(rows.withColumn("topic", F.lit("36")), str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).where("topic = '36'").count() == 4


def test_predictors(spark):
    df = spark.createDataFrame([(1, "a cat"), (2, "dog")], "pair_id int, prompt string")
    got = predictors.predict(df, predictors.create("keyword", "cat"), repeat=2, temperatures=(0.2, 1.0))
    v = {(r.pair_id, r.temperature): (r.yes, r.valid, r.repeat) for r in metrics.vote_counts(got, ["pair_id", "temperature"]).collect()}
    assert v == {(1, 0.2): (2, 2, 2), (1, 1.0): (2, 2, 2), (2, 0.2): (0, 2, 2), (2, 1.0): (0, 2, 2)}
    with pytest.raises(KeyError):
        predictors.create("nothing")


def test_splits(spark):
    df = spark.createDataFrame([(1,), (2,), (24,), (36,), (45,)], "t int")
    assert [r[0] for r in df.select(filters.split_name("t")).collect()] == ["train", "dev", "train", "test", "test"]
    assert [r[0] for r in df.select(filters.split_name("t", 1)).collect()] == ["train", "train", "dev", "test", "test"]
    with pytest.raises(ValueError):
        filters.union_checked([df, df], 3)
