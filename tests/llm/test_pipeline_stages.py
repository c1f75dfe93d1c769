"""Pipeline stages on cases that the driver's tables lack."""

import corpus_pipeline as P
from compare import DATA
from test_jaccard import brute

SF = f"{DATA}/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows], COLUMNS)


def test_near_copies_by_five_words(spark):
    words = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(words))
    # 0 and 2 share 176 of 216 shingles of five words (81 %), and 186 of 210 of three (under 90 %)
    docs = [(0, edited()), (1, edited(40, 120)), (2, edited(30, 80, 130, 170)), (3, edited(*range(0, 200, 12))), (4, "other words " * 3)]
    want = sorted(set(brute(docs, 5, 80)[1].values()))
    got = P.jaccard_stage(spark, table(spark, [(d, t, "en") for d, t in docs]), SF)
    assert sorted(r.doc_id for r in got.collect()) == want == [0, 3, 4]
    assert sorted(set(brute(docs)[1].values())) != want


def test_near_copies_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set(brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)[1].values())
    assert sorted(r.doc_id for r in P.jaccard_stage(spark, docs, SF).collect()) == sorted(want)


#: Texts in no language of the tables, and letters without a language.
FOREIGN = [
    "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset",
    "Język polski należy do grupy zachodniosłowiańskiej rodziny języków indoeuropejskich i jest używany w Polsce",
    "Русский язык является одним из восточнославянских языков и национальным языком русского народа",
    "中文是世界上使用人数最多的语言之一也是联合国工作语言",
    "Türkçe ya da Türk dili, batıda Balkanlardan başlayıp doğuda Hazar Denizi sahasına kadar konuşulan bir dildir",
    "qzxv jkwq pfgh zzxq vbnm wqrt ghjk xcvz plkj qwzx mnbv",
]


def test_foreign_texts_and_gibberish_are_rejected(spark):
    clean = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    extra = table(spark, [(10**9 + i, t, None) for i, t in enumerate(FOREIGN)])
    kept = {r.doc_id for r in P.language_stage(spark, clean.unionByName(extra), SF).collect()}
    assert not [i for i in range(len(FOREIGN)) if 10**9 + i in kept]
    lost = [r.text for r in clean.collect() if r.doc_id not in kept and any(c.isalpha() for c in r.text or "")]
    assert not lost


def test_different_texts_of_one_id_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, one, "en"), (1, two, "en"), (1, two, "en"), (2, one, "en"), (3, "", "en"), (3, "", "en")]
    got = P.jaccard_stage(spark, table(spark, rows), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (1, two), (3, "")])


def test_awkward_rows_with_all_their_columns_pass_every_stage(spark, awkward):
    """Columns named like those that operators add stay as they are."""
    docs = awkward.withColumnRenamed("v", "_spans_").withColumnRenamed("shard", "found").withColumnRenamed("piece", "lang_pred")
    columns, docs = docs.columns, docs
    for name, f in P.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == columns
        assert {(r.score, r.component_id, r._spans_, r.found, r.lang_pred) for r in docs.collect()} == {(0.5, -1, "x", 7, 9)}
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0


def test_names_with_dots_and_backticks_pass_every_stage(spark, awkward):
    docs = awkward.withColumnRenamed("v", "a.b").withColumnRenamed("shard", "c`d").withColumnRenamed("piece", "e f")
    columns = docs.columns
    for name, f in P.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == columns, name
        assert {(r["a.b"], r["c`d"], r["e f"]) for r in docs.collect()} == {("x", 7, 9)}
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0


def test_no_rows_pass_every_stage(spark, no_docs):
    docs = no_docs
    for _, f in P.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
