"""Table functions called from SQL text."""

from pyspark.sql import Window, functions as F

from ..functions import tables
from . import bindings as B
from .q_graph import _CC, _NODES
from .q_sources import _TOKENS, _tokens
from .registry import query


def _corpus(spark, sf_dir):
    """A document of annotated XML for each conversation: every token of its turns; a turn's first two tokens are a mention, all those of users one chain."""
    roles = B.sentences(spark, sf_dir).select("doc_id", "sent_id", "role")
    t = _tokens(spark, sf_dir).withColumn("t_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", "i")))
    clean = F.replace(F.replace(F.replace("token", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = t.join(roles, ["doc_id", "sent_id"])
    token = F.format_string('<token t_id="%d" sentence="%d" number="%d">%s</token>', "t_id", "sent_id", "i", clean)
    anchor = F.format_string('<token_anchor t_id="%d"/>', "t_id")
    turns = t.groupBy("doc_id", "sent_id", "role").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("t_id", token.alias("x"))))["x"], "").alias("tokens"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") < 2, F.struct("t_id", anchor.alias("x")))))["x"], "").alias("anchors"),
    )
    mark = F.concat(F.lit('<ACTION_X m_id="'), F.col("sent_id").cast("string"), F.lit('">'), F.col("anchors"), F.lit("</ACTION_X>"))
    source = F.when(F.col("role") == "user", F.concat(F.lit('<source m_id="'), F.col("sent_id").cast("string"), F.lit('"/>')))
    ordered = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct("sent_id", c.alias("x"))))["x"], "")
    docs = turns.groupBy("doc_id").agg(ordered(F.col("tokens")).alias("t"), ordered(mark).alias("m"), ordered(F.coalesce(source, F.lit(""))).alias("s"))
    whole = F.concat(F.lit("<Document>"), "t", F.lit("<Markables>"), "m", F.lit('</Markables><Relations><INTRA_DOC_COREF r_id="1">'), "s", F.lit('<target m_id="x"/></INTRA_DOC_COREF></Relations></Document>'))
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"), whole.alias("text"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, i) AS t_id FROM {_TOKENS})
  SELECT 'c' || doc_id AS doc_id, sent_id::VARCHAR AS m_id, sent_id::INT AS sent_id, list(t_id::INT ORDER BY i) AS tokens_ids, string_agg(token, ' ' ORDER BY i) AS tokens_str, 'ACT' AS mention_type,
    CASE WHEN any_value(role) = 'user' THEN 'INTRA_ACT_1_c' || doc_id ELSE 'Singleton_ACT_' || sent_id || '_c' || doc_id END AS coref_chain, any_value(role) <> 'user' AS is_singleton
  FROM t JOIN (SELECT doc_id, sent_id, role FROM {B.SENTENCES}) USING (doc_id, sent_id) WHERE i < 2 GROUP BY doc_id, sent_id""")
def markables_of_documents(spark, sf_dir):
    """Mentions of XML documents made of whole conversations, by a table function in SQL."""
    tables.register(spark)
    docs = _corpus(spark, sf_dir)
    return spark.sql("SELECT doc_id, m_id, sent_id, tokens_ids, tokens_str, mention_type, coref_chain, is_singleton FROM markables(TABLE({docs}) PARTITION BY name)", docs=docs)


@query(_CC.format(edges=f"SELECT block AS k, a, b FROM {B.PREDICTIONS} WHERE pred", nodes=_NODES))
def chains_by_table_function(spark, sf_dir):
    """Chains of each document by a table function in SQL."""
    tables.register(spark)
    pairs = B.predictions(spark, sf_dir).selectExpr("block", "a", "b", "cast(pred as double) as score")
    return spark.sql("SELECT * FROM assign_chains(TABLE({pairs}) PARTITION BY (block), 0.5D)", pairs=tables.reduced_pairs(pairs, 0.5))
