"""The pipeline against its stages' plain meaning."""

import re

import corpus_pipeline as P
import pytest
from compare import DATA
from test_jaccard import brute
from test_secrets_warc import python_spans

from mentionmill.llm import q_toxicity

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from mentionmill.storage import Scratch

    scratch, out = Scratch(spark, "t"), {}
    docs = out["start"] = spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in P.STAGES:
        docs = out[name] = scratch.table(f(spark, docs, SF), name)
    return out


def test_names_and_columns(stages):
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "toxicity", "jaccard_join", "secret_scan", "best_fit"]
    for n in names[:-1]:
        assert stages[n].columns == stages["start"].columns


def test_language_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages["language_id"].collect()}
    lost = [r for r in stages["start"].collect() if r.doc_id not in kept]
    assert all(not re.search(r"[^\W\d_]{3}", r.text or "") for r in lost)


def test_toxicity_rejects_what_the_query_predicts(spark, stages):
    model = q_toxicity.train(stages["language_id"], spark.read.parquet(f"{SF}/labels.parquet"))
    from mentionmill.llm.toxicity import score

    bad = {r.doc_id for r in score(stages["language_id"], model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in stages["toxicity"].collect()} == {r.doc_id for r in stages["language_id"].collect()} - bad


def test_one_document_of_each_group_stays(stages):
    docs = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    comp = brute(docs, P.NEAR_WORDS, P.NEAR_PERCENT)[1]
    kept = [r.doc_id for r in stages["jaccard_join"].collect()]
    assert (P.NEAR_WORDS, P.NEAR_PERCENT) == (5, 80)
    assert sorted(kept) == sorted(set(comp.values())) and len(kept) < len(docs)


def test_secrets_are_gone(stages):
    before = {r.doc_id: r for r in stages["jaccard_join"].collect()}
    for r in stages["secret_scan"].collect():
        assert r.n_chars == len(r.text)
        assert bool(python_spans(before[r.doc_id].text)) == ("[SECRET]" in r.text)
        assert not [s for s in python_spans(r.text) if s[1] < 4]


def test_run_gives_the_last_stage(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r) for r in P.run(spark, SF).select(cols).collect())
    assert got == sorted(tuple(r) for r in stages["best_fit"].select(cols).collect())
    assert {r[0] for r in got} == {r.doc_id for r in stages["secret_scan"].collect()}


def test_awkward_rows_pass_every_stage(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in P.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() > 0


def test_empty_table_passes_every_stage(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in P.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
