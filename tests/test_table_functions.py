"""Table functions in SQL text against the operators."""

import random

import pytest

from mentionmill.functions import tables
from mentionmill.operators.scoring import cluster
from mentionmill.sources import annotated


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    tables.register(spark)


XML = """<Document><token t_id="1" sentence="0" number="0">Tom &amp; é</token><token t_id="2" sentence="0" number="1">ran</token><token t_id="3" sentence="1" number="0">he</token><token t_id="4" sentence="1" number="4">fast</token>
<Markables><HUMAN_PART m_id="1"><token_anchor t_id="1"/></HUMAN_PART><ACTION_X m_id="2"><token_anchor t_id="2"/><token_anchor t_id="3"/></ACTION_X><OTHER m_id="3"><token_anchor t_id="3"/><token_anchor t_id="4"/></OTHER>
<UNKNOWN_INSTANCE_TAG m_id="5"><token_anchor t_id="4"/><token_anchor t_id="2"/></UNKNOWN_INSTANCE_TAG><LOC m_id="6"><token_anchor t_id="99"/></LOC><LOC_X m_id="7"/><ACTION_X m_id="9" RELATED_TO="" TAG_DESCRIPTOR="x" instance_id="A"/></Markables>
<Relations><CROSS_DOC_COREF r_id="7" note="n1"><source m_id="1"/><target m_id="9"/></CROSS_DOC_COREF><INTRA_DOC_COREF r_id="8"><source m_id="2"/><target m_id="9"/></INTRA_DOC_COREF><CROSS_DOC_COREF r_id="4"><source m_id="5"/></CROSS_DOC_COREF></Relations></Document>"""


def test_markables_equal_the_parsed_tables(spark):
    rows = [("a_1.xml", XML), ("b.xml", XML.replace("n1", "n2")), ("bad.xml", "<Doc"), ("worse.xml", XML.replace('number="4"', "")), ("none.xml", None), (None, XML), ("empty.xml", "")]
    docs = spark.createDataFrame(rows, "name string, text string")
    t = annotated.tables(annotated.parse_annotations(docs.where("name is not null and text is not null")))
    want = annotated.mentions_of(t["markables"], t["tokens"], t["relations"])
    got = spark.sql("SELECT * FROM markables(TABLE({d}) PARTITION BY name)", d=docs)
    columns = sorted(set(want.columns))
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert got.count() == 8


@pytest.mark.parametrize("kind", ["long", "string"])
def test_chains_equal_cluster(spark, kind):
    rnd = random.Random(4)
    rows = [(b, f"{rnd.randrange(30):03d}", f"{rnd.randrange(30):03d}", rnd.choice([None, 0.1, 0.5, 0.7])) for b in ("x", "y", None) for _ in range(40)]
    df = spark.createDataFrame(rows, "block string, a string, b string, score double").selectExpr("block", f"cast(a as {kind}) a", f"cast(b as {kind}) b", "score")
    got = spark.sql("SELECT * FROM assign_chains(TABLE({d}) PARTITION BY (block), 0.5D)", d=df)
    want = cluster(df, 0.5)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.sql("SELECT * FROM assign_chains(TABLE({d}) PARTITION BY (block), 0.5D)", d=df.limit(0)).count() == 0


def test_wrong_tables_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "block int, a int")
    with pytest.raises(Exception, match="no column b"):
        spark.sql("SELECT * FROM assign_chains(TABLE({d}) PARTITION BY (block), 0.5D)", d=df)
    with pytest.raises(Exception, match="no column name"):
        spark.sql("SELECT * FROM markables(TABLE({d}) PARTITION BY block)", d=df)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_chains_of_reduced_pairs(spark, monkeypatch, kind):
    """Pairs reduced before the function give the same chains, and are at most one row for each mention and ``HELD`` pairs."""
    monkeypatch.setattr(tables, "HELD", 50)
    rnd = random.Random(8)
    rows = [(b, f"{i:03d}", f"{j:03d}", rnd.choice([None, 0.1, 0.1, 0.1, 0.1, 0.5, float("nan")])) for b in ("x", "y", None) for i in range(25) for j in range(i + 1, 25)] + [("z", None, "001", 1.0), ("w", "007", "007", 1.0)]
    df = spark.createDataFrame(rows, "block string, a string, b string, score double").selectExpr("block", f"cast(a as {kind}) a", f"cast(b as {kind}) b", "score").repartition(1)
    less = tables.reduced_pairs(df, 0.5)
    chains = lambda d: sorted(map(str, spark.sql("SELECT * FROM assign_chains(TABLE({d}) PARTITION BY (block), 0.5D)", d=d).collect()))
    assert chains(less) == chains(df) and len(chains(df)) == 76
    monkeypatch.setattr(tables, "HELD", 1 << 18)
    assert tables.reduced_pairs(df, 0.5).count() == 76


def test_query_reduces_its_pairs(spark, monkeypatch):
    from mentionmill.plans import registry

    seen = []
    real = tables.reduced_pairs
    monkeypatch.setattr(tables, "reduced_pairs", lambda pairs, t: seen.append(t) or real(pairs, t))
    assert registry.QUERIES["chains_by_table_function"](spark, "/root/testdata/sf0.001").columns == ["block", "mention", "cluster"] and seen == [0.5]
