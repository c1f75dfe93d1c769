"""Queries on files and on the operators beside them: each writes what a corpus or an experiment leaves, and reads it back."""

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, graph, matching, metrics, pairs, predictors, scoring, stats
from ..sources import annotated, conll, conll_format, predictions
from ..storage import Scratch, new_path
from . import bindings as B
from .q_text import _UNTOK
from .registry import query


def _lines(df, value, label: str) -> str:
    """Lines written as text files; their folder."""
    path = new_path(df.sparkSession, label)
    df.select(value.alias("value")).write.text(path)
    return path


_TOKENS = f"(SELECT doc_id, sent_id, i - 1 AS i, regexp_replace(tokens[i], '[\\t\\r]', '_', 'g') AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM {B.SENTENCES}))"


def _tokens(spark, sf_dir):
    flat = B.sentences(spark, sf_dir).select("doc_id", "sent_id", F.posexplode("tokens").alias("i", "token"))
    return flat.withColumn("token", F.regexp_replace("token", r"[\t\r]", "_"))


@query(f"SELECT 'd' || doc_id AS doc_id, sent_id::INT AS sent_id, i::INT AS number, token, 'c' || (i % 3) AS chain FROM {_TOKENS}")
def token_table(spark, sf_dir):
    """Tab-separated tokens with empty cells and blank lines."""
    t = _tokens(spark, sf_dir)
    row = F.concat_ws("\t", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit(""), F.col("sent_id").cast("string"), F.col("i").cast("string"), "token", F.concat(F.lit("c"), (F.col("i") % 3).cast("string")))
    path = _lines(t, F.concat(row, F.when(F.col("i") == 0, "\n").otherwise("")), "token-table")
    return annotated.read_token_table(spark, path)


@query("SELECT conv_id || '_' || (turn % 5) || 'ecb' AS doc_id, turn::INT AS sent_id FROM conversations")
def selected_sentences(spark, sf_dir):
    c = B.read(spark, sf_dir, "conversations")
    path = new_path(spark, "selected")
    c.select(F.col("conv_id").alias("Topic"), F.concat((F.col("turn") % 5).cast("string"), F.lit("ecb.xml")).alias("File"), F.col("turn").alias("Sentence Number")).write.csv(path, header=True)
    return annotated.read_selected(spark, path)


@query("""SELECT doc_id::VARCHAR AS doc_id, 'wd' AS scope, toxic::INT AS label, 'a "b"' || chr(10) || 'c, ' || doc_id AS text, '22MAU' AS template, (doc_id % 6)::INT AS correct, 5::INT AS valid, 7::INT AS repeat FROM labels""")
def prediction_file(spark, sf_dir):
    """Votes of one template from a CSV with quotes and line ends in its cells."""
    d = B.read(spark, sf_dir, "labels")
    path = new_path(spark, "predictions")
    d.select(
        "doc_id", F.lit("wd").alias("wd/cd"), "toxic", F.concat(F.lit('a "b"\nc, '), F.col("doc_id").cast("string")).alias("text"),
        F.concat(F.lit("["), (F.col("doc_id") % 6).cast("string"), F.lit(", 5, 7]")).alias("22MAU"),
    ).withColumnRenamed("toxic", "label").write.csv(path, header=True, escape='"')
    return predictions.read_predictions_v2(spark, path, "22MAU")


@query("""SELECT 'm' AS model, p AS prompt, (doc_id % (p + 2))::INT AS yes, 5::INT AS valid, toxic::INT AS label FROM labels, (SELECT unnest([1, 2])::INT AS p)""")
def older_prediction_file(spark, sf_dir):
    """Answers of several prompts in long form, rows of totals and repeated headers left out, under a model's name."""
    d = B.read(spark, sf_dir, "labels")
    vote = lambda p: F.concat(F.lit("["), (F.col("doc_id") % (p + 2)).cast("string"), F.lit(", 5]")).alias(f"Prompt {p}")
    rows = d.select(vote(1), vote(2), F.col("toxic").cast("double").cast("string").alias("label"), F.lit("t").alias("text"))
    extra = spark.createDataFrame([("Prompt 1", "Prompt 2", "label", "text"), ("[1, 2]", "[3, 4]", None, "total")], rows.schema)
    path = new_path(spark, "older")
    rows.unionByName(extra).write.csv(path, header=True, escape='"')
    return predictions.normalise_v1(predictions.read_predictions_v1(spark, path), "m")


_CONLL = f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, i) - 1 AS i, length(token) % 5 AS c FROM {_TOKENS})"


def _conll_documents(spark, sf_dir):
    """A document each: one-token chains at every third place, spans of two from every sixth on."""
    t = _tokens(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "i", F.length("token").alias("n")))).alias("t"))
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    cell = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("("), (x["n"] % 5).cast("string"), F.lit(")"))).when(i % 6 == 1, "-|(s").when(i % 6 == 2, "s)").otherwise("-")
    line = lambda x, i: F.concat_ws("\t", doc, i.cast("string"), cell(x, i))
    body = F.concat(F.lit("#begin document ("), doc, F.lit("); part 000\n"), F.array_join(F.transform("t", line), "\n"), F.lit("\n\n#end document"))
    return t.select("doc_id", body.alias("value"))


@query(f"""WITH n AS (SELECT doc_id, max(i) AS last FROM {_CONLL} GROUP BY doc_id)
  SELECT 'd' || doc_id AS doc, i::INT AS "begin", i::INT AS "end", c::VARCHAR AS chain FROM {_CONLL} WHERE i % 3 = 0
  UNION ALL SELECT 'd' || doc_id, i::INT, (i + 1)::INT, 's' FROM {_CONLL} JOIN n USING (doc_id) WHERE i % 6 = 1 AND i < last""")
def conll_mentions(spark, sf_dir):
    """Mentions of coreference files, spans over lines included; a span that never closes is none."""
    docs = _conll_documents(spark, sf_dir)
    return conll.read_conll(spark, _lines(docs, F.col("value"), "conll")).select("doc", "begin", "end", "chain")


_SPANS = f"""(WITH n AS (SELECT doc_id, max(i) AS last FROM {_CONLL} GROUP BY doc_id)
  SELECT 'd' || doc_id AS doc, i::INT AS "begin", i::INT AS "end", c::VARCHAR AS chain FROM {_CONLL} WHERE i % 3 = 0
  UNION ALL SELECT 'd' || doc_id, i::INT, (i + 1)::INT, 's' FROM {_CONLL} JOIN n USING (doc_id) WHERE i % 6 = 1 AND i < last)"""


def _conll_folder(spark, sf_dir):
    """Mentions of the turns, written by documents and tasks; the folder."""
    from pyspark.sql import Window

    t = _tokens(spark, sf_dir).select("doc_id", (F.length("token") % 5).cast("string").alias("c"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", "i")) - 1).alias("i"))
    own = t.groupBy("doc_id").agg(F.max("i").alias("last"))
    one = t.where("i % 3 = 0").select("doc_id", F.col("i").alias("begin"), F.col("i").alias("end"), F.col("c").alias("chain"))
    two = t.where("i % 6 = 1").join(own, "doc_id").where("i < last").select("doc_id", F.col("i").alias("begin"), (F.col("i") + 1).alias("end"), F.lit("s").alias("chain"))
    conll_format.register(spark)
    path = new_path(spark, "conll-format")
    conll_format.write_mentions(one.unionByName(two).withColumn("doc", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), path)
    return path


@query(f"SELECT * FROM {_SPANS}")
def conll_format_mentions(spark, sf_dir):
    """Mentions written and read by the data source of coreference files, cut into small ranges."""
    path = _conll_folder(spark, sf_dir)
    return spark.read.format("conll").option("rangeBytes", 1 << 16).load(path).select("doc", "begin", "end", "chain")


@query(f"SELECT chain, count(*) AS n, sum(\"end\")::BIGINT AS ends FROM {_SPANS} WHERE doc IN ('d1', 'd3', 'd8') AND \"begin\" > 5 GROUP BY chain")
def conll_format_documents(spark, sf_dir):
    """A few documents by the source's option; the others' lines are not parsed."""
    path = _conll_folder(spark, sf_dir)
    df = spark.read.format("conll").option("docs", '["d1", "d3", "d8"]').load(path)
    return df.where("begin > 5").groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends"))


@query(f"""WITH n AS (SELECT doc_id, count(*) AS n FROM {_CONLL} GROUP BY doc_id)
  SELECT 'all' AS file, 'd' || doc_id AS doc, (coalesce(sum(n + 3) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin_line FROM n""")
def conll_document_index(spark, sf_dir):
    """First line of each document of a file that holds them all."""
    docs = _conll_documents(spark, sf_dir).withColumn("l", F.split("value", "\n"))
    n = docs.select("doc_id", F.size("l").cast("long").alias("n"))
    before = filters.running_sums(n.withColumn("upto", F.col("n")), F.col("doc_id"), ["upto"]).select("doc_id", (F.col("upto") - F.col("n")).alias("at"))
    lines = docs.join(before, "doc_id").select("at", F.posexplode("l").alias("i", "value")).select(F.lit("all").alias("file"), (F.col("at") + F.col("i")).alias("line"), "value")
    return conll.document_index(lines)


@query(f"SELECT topic::INT AS topic, mention::VARCHAR AS m_id, 'd' || doc_id AS doc_id, sent_id::INT AS sentence_id, gold::BIGINT AS cluster_id, [pos, pos + 1]::INT[] AS tokens_ids FROM {B.MENTIONS}")
def json_mentions(spark, sf_dir):
    """Mentions from JSON files of one array each."""
    m = B.mentions(spark, sf_dir)
    row = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("mention").cast("string").alias("m_id"), F.col("sent_id").alias("sentence_id"), F.col("gold").alias("cluster_id"), F.array("pos", F.col("pos") + 1).alias("tokens_ids"))
    path = new_path(spark, "json")
    m.groupBy("topic").agg(F.to_json(F.collect_list(row)).alias("value")).write.partitionBy("topic").text(path)
    return annotated.read_json_mentions(spark, path).select("topic", "m_id", "doc_id", "sentence_id", "cluster_id", "tokens_ids")


@query(f"SELECT mention AS id, 'x, \"' || topic || '\"' AS name, gold / 4.0::DOUBLE AS value FROM {B.MENTIONS}")
def headerless_table(spark, sf_dir):
    m = B.mentions(spark, sf_dir)
    path = new_path(spark, "headerless")
    m.select("mention", F.concat(F.lit('x, "'), F.col("topic").cast("string"), F.lit('"')), (F.col("gold") / 4.0)).write.csv(path)
    return predictions.read_headerless(spark, path, "id long, name string, value double")


@query(f"""SELECT doc_id, sent_id, i, CASE WHEN lower(token) IN (SELECT DISTINCT lower(trim(token)) FROM {_TOKENS} WHERE length(token) <= 2 AND NOT token LIKE '#%') THEN 'PRON' ELSE 'X' END AS tag FROM {_TOKENS}""")
def pronoun_tags(spark, sf_dir):
    """Tags of tokens, those of a word list overridden; the list has blanks, comments and both cases."""
    t = _tokens(spark, sf_dir)
    short = t.where("length(token) <= 2").select("token").distinct()
    other = short.select(F.translate("token", string.ascii_lowercase, string.ascii_uppercase).alias("token"))  # ASCII alone: the upper case of a sharp s is another word
    path = _lines(short.unionByName(other).unionByName(spark.createDataFrame([("# no words",), ("",)], "token string")), F.concat(F.lit(" "), "token", F.lit(" ")), "words")
    words = [r.word for r in annotated.read_word_list(spark, path).collect()]  # a word list is short
    return t.select("doc_id", "sent_id", F.col("i").cast("long").alias("i"), text.pronoun_override(F.lit("X"), "token", words).alias("tag"))


@query(f"SELECT 'v' || mention AS word, [gold / 4.0, -topic / 2.0, doc_id]::FLOAT[] AS vector FROM {B.MENTIONS}")
def text_vectors(spark, sf_dir):
    m = B.mentions(spark, sf_dir)
    path = _lines(m, F.concat_ws(" ", F.concat(F.lit("v"), F.col("mention").cast("string")), (F.col("gold") / 4.0).cast("string"), (-F.col("topic") / 2.0).cast("string"), F.col("doc_id").cast("string")), "vectors")
    return annotated.read_vectors(spark, path)


@query("""WITH a AS (SELECT user_id AS doc, event_id AS event, ['vi', 'cli', 'a view!'][event_id % 3 + 1] AS text FROM events WHERE event_type = 'purchase'),
  e AS (SELECT user_id AS doc, event_id AS mention, event_type AS text FROM events WHERE event_type <> 'purchase')
  SELECT a.doc, event, 'A0' AS role, min(mention) AS mention FROM a JOIN e ON a.doc = e.doc AND (contains(e.text, a.text) OR contains(a.text, e.text)) GROUP BY ALL""")
def argument_match_by_text(spark, sf_dir):
    """First entity whose text holds the argument's or is held by it."""
    e = B.read(spark, sf_dir, "events")
    pick = F.element_at(F.array(F.lit("vi"), F.lit("cli"), F.lit("a view!")), (F.col("event_id") % 3 + 1).cast("int"))
    side = e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("mention"), "event_type")
    args = side.where("event_type = 'purchase'").select("doc", F.col("mention").alias("event"), F.lit("A0").alias("role"), F.element_at(F.array(F.lit("vi"), F.lit("cli"), F.lit("a view!")), (F.col("mention") % 3 + 1).cast("int")).alias("text"))
    args = args.withColumn("tokens", F.array("text"))
    ents = side.where("event_type <> 'purchase'").select("doc", "mention", F.lit("HUM").alias("type"), F.col("event_type").alias("text"), F.array("event_type").alias("tokens"), F.col("mention").alias("pos"))
    return matching.argument_match(args, ents, ["doc"], text_only=True).select("doc", "event", "role", "argument.mention")


@query(f"SELECT 'd' || doc_id AS doc_id, 'm' || sent_id AS m_id, [2 * sent_id + 1, 2 * sent_id + 2]::INT[] AS tokens_ids FROM {B.SENTENCES}")
def reindexed_tokens(spark, sf_dir):
    """Places of mention tokens among the clean tokens of their document, found one after another; some are cut short."""
    s = B.sentences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "sent_id")
    n = s.groupBy("doc_id").agg((F.max("sent_id") * 2 + 3).alias("n"))
    docs = n.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.concat(F.lit("w"), i.cast("string"), F.lit("-"), (i % 2).cast("string"))).alias("clean_tokens"))
    word = lambda i, end: F.concat(F.lit("w"), i.cast("string"), F.lit("-"), end)
    at = F.col("sent_id") * 2 + 1
    m = s.select("doc_id", F.concat(F.lit("m"), F.col("sent_id").cast("string")).alias("m_id"), F.array(F.col("sent_id") * 10, F.col("sent_id") * 10 + 1).alias("raw_ids"), F.array(word(at, F.lit("1")), word(at + 1, F.lit(""))).alias("tokens"))
    return matching.reindex_tokens(docs, m)


@query(f"SELECT block, a, b, pred FROM {B.PREDICTIONS} UNION ALL SELECT block, b, a, pred FROM {B.PREDICTIONS}")
def triangle_legs(spark, sf_dir):
    """Each pair under both orders of its ends."""
    return matching.triangle_legs(B.predictions(spark, sf_dir))


@query(f"SELECT topic, gold, list_sort(list(mention)) AS mentions FROM {B.MENTIONS} GROUP BY ALL")
def cluster_members(spark, sf_dir):
    return stats.cluster_members(B.mentions(spark, sf_dir), ["topic", "gold"])


_COSINE = """list_sum([x.vector[i]::DOUBLE * y.vector[i]::DOUBLE FOR i IN range(1, 65)]) / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN x.vector]))
  / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN y.vector]))"""


@query(f"""WITH RECURSIVE e AS (SELECT x.topic AS k, x.mention AS a, y.mention AS b FROM {B.MENTIONS} x JOIN {B.MENTIONS} y ON x.topic = y.topic AND x.pos < y.pos WHERE {_COSINE} >= 0.3),
  both_e AS (SELECT k, a, b FROM e UNION SELECT k, b, a FROM e),
  reach AS (SELECT topic AS k, mention AS node, mention AS seen FROM {B.MENTIONS} UNION SELECT r.k, r.node, x.b FROM reach r JOIN both_e x ON x.k = r.k AND x.a = r.seen)
  SELECT k AS block, node AS mention, min(seen) AS cluster FROM reach GROUP BY ALL""")
def cluster_across_documents(spark, sf_dir):
    """Components of the mention pairs of a topic, over its documents, whose vectors are near."""
    m = B.mentions(spark, sf_dir, vector=True).select("topic", "mention", "pos", "vector")

    def stars(t):
        """The links of two tiles as stars of the same components."""
        node, low = graph.lowest(t["m1_mention"].to_numpy(), t["m2_mention"].to_numpy())
        far = node != low
        return pa.table({"block": pa.array(np.repeat(t["topic"][:1].to_numpy(), far.sum())), "a": pa.array(node[far]), "b": pa.array(low[far]), "score": pa.array(np.full(far.sum(), 30.0))})

    near = pairs.similar_pairs(m, "topic", least=30.0, fold=stars, schema="block long, a long, b long, score double")
    near = Scratch(spark, "near").table(near, "stars")  # read for the mentions and for the links
    own = m.select(F.col("topic").alias("block"), F.col("mention").alias("a"), F.col("mention").alias("b"), F.lit(None).cast("double").alias("score"))  # a mention without a near one is alone
    return scoring.cluster(near.unionByName(own), 30.0)


@query("SELECT conv_id, turn, i, CASE i WHEN 1 THEN 'user' ELSE 'assistant' END AS role, CASE i WHEN 1 THEN 'what ' || turn ELSE role || '!' END AS content FROM conversations, (SELECT unnest([1, 2]) AS i)")
def chat_messages(spark, sf_dir):
    """Messages of a prefix of worked examples; lines without a mark are left out."""
    c = B.read(spark, sf_dir, "conversations")
    prefix = F.concat(F.lit("Q: what "), F.col("turn").cast("string"), F.lit("\nnoise\nA: "), "role", F.lit("!"))
    m = c.select("conv_id", "turn", F.posexplode(text.chat_messages(prefix)).alias("i", "m"))
    return m.select("conv_id", "turn", (F.col("i") + 1).alias("i"), "m.role", "m.content")


@query(f"""SELECT doc_id, sent_id, array_to_string([{_UNTOK.replace("(t,", "(x,")} FOR x IN string_split(t, '[EOS]')], '[EOS]') AS text
  FROM (SELECT doc_id, sent_id, array_to_string([CASE WHEN tokens[i] LIKE '%.' THEN rtrim(tokens[i], '.') || ' . [EOS]' ELSE tokens[i] END FOR i IN range(1, len(tokens) + 1)], ' ') AS t FROM {B.SENTENCES})""")
def cleaned_sentences(spark, sf_dir):
    """Sentences of a document untokenized one by one between their marks."""
    cut = lambda x: F.when(x.endswith("."), F.concat(F.rtrim(x, F.lit(".")), F.lit(" . [EOS]"))).otherwise(x)
    return B.sentences(spark, sf_dir).select("doc_id", "sent_id", text.clean_sentences(F.array_join(F.transform("tokens", cut), " ")).alias("text"))


@query(f"SELECT block, a, b, i, CASE i WHEN 1 THEN 'm ' || a ELSE 'it''s' END AS tokens, [a, b]::INT[] AS tokens_ids, (CASE i WHEN 1 THEN a ELSE b END)::VARCHAR AS m_id, i::BIGINT AS cluster_id FROM {B.PREDICTIONS}, (SELECT unnest([1, 2]) AS i)")
def pair_dicts(spark, sf_dir):
    """Two serialised mentions of a pair, one a line, read back as rows."""
    one = lambda m, t, i: F.concat(F.lit("{'tokens': "), t, F.lit(", 'tokens_ids': ["), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"), F.lit("], 'm_id': '"), F.col(m).cast("string"), F.lit(f"', 'cluster_id': {i}}}"))
    both = F.concat(one("a", F.concat(F.lit("'m "), F.col("a").cast("string"), F.lit("'")), 1), F.lit(" \n "), one("b", F.lit('"it\'s"'), 2))
    # the outer form: before the plain one Spark puts a filter that parses every text once more
    p = B.predictions(spark, sf_dir).select("block", "a", "b", F.posexplode_outer(text.parse_pair_dicts(both)).alias("i", "x")).where("i is not null")
    return p.select("block", "a", "b", (F.col("i") + 1).alias("i"), "x.tokens", "x.tokens_ids", "x.m_id", "x.cluster_id")


@query(f"""WITH s AS (SELECT lang, 's' || (doc_id % 3) AS setting, {B.COUNTS} FROM {B.LABELLED} GROUP BY ALL),
  t AS (SELECT lang, setting, printf('%.4f', coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) AS v FROM s),
  p AS (SELECT coalesce(lang, '') AS lang, coalesce(max(v) FILTER (setting = 's0'), '-') AS s0, coalesce(max(v) FILTER (setting = 's9'), '-') AS s9 FROM t GROUP BY 1)
  SELECT 0::BIGINT AS line, chr(92) || 'begin{{tabular}}{{lll}}' AS value UNION ALL SELECT 1, 'lang & s' || chr(92) || '_0 & s9 ' || chr(92) || chr(92)
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY lang), lang || ' & ' || s0 || ' & ' || s9 || ' ' || chr(92) || chr(92) FROM p
  UNION ALL SELECT 2 + count(*), chr(92) || 'end{{tabular}}' FROM p""".replace("{{", "{").replace("}}", "}"))
def latex_report(spark, sf_dir):
    """The pivot of scores as lines of a LaTeX table."""
    rows = B.labelled(spark, sf_dir).withColumn("setting", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    report = metrics.pivot_report(metrics.binary_metrics(rows, ["lang", "setting"]), ["lang"], "setting", ["s0", "s9"], metrics.f1_text())
    return predictions.latex_lines(report.withColumnRenamed("s0", "s_0"), ["lang"])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer FROM labels")
def retried_answers(spark, sf_dir):
    """A predictor that fails at first, asked again after a wait."""
    p = B.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("prompt"))
    got = predictors.predict(p, predictors.create("retrying", predictors.create("failing", "even", 2), 3, 0.001))
    return got.select("doc_id", "answer")


@query(f"SELECT mention AS n, mention || '##############' || chr(10) || 'is it ' || gold AS value FROM {B.MENTIONS}")
def prompt_log(spark, sf_dir):
    m = B.mentions(spark, sf_dir).select(F.col("mention").alias("n"), F.concat(F.lit("is it "), F.col("gold").cast("string")).alias("prompt"))
    return predictions.prompt_log(m)


@query(f"SELECT gold::VARCHAR AS gold, count(*)::VARCHAR AS n, 'a, \"b\"' AS note FROM {B.MENTIONS} GROUP BY gold")
def score_file(spark, sf_dir):
    """A list of scores as CSV, read back as text."""
    m = B.mentions(spark, sf_dir).groupBy("gold").agg(F.count(F.lit(1)).alias("n")).withColumn("note", F.lit('a, "b"'))
    path = new_path(spark, "scores")
    predictions.write_scores(m, path)
    return spark.read.csv(path, header=True, escape='"', schema="gold string, n string, note string")


@query(f"SELECT topic, mention, [gold, pos] AS ids FROM {B.MENTIONS}")
def pair_files(spark, sf_dir):
    """Rows written by topic as parquet, and as JSON, read back and joined."""
    m = B.mentions(spark, sf_dir).select("topic", "mention", F.array("gold", "pos").alias("ids"))
    one, two = new_path(spark, "pairs"), new_path(spark, "dump")
    predictions.write_pairs(m.select("topic", "mention"), one)
    predictions.write_json(m.select("mention", "ids"), two)
    held = spark.read.schema("mention long, topic long").parquet(one)
    return held.join(spark.read.schema("mention long, ids array<long>").json(two), "mention").select("topic", "mention", "ids")


@query("SELECT conv_id || ' ' || turn AS text, [role, 'it'] AS pair, [turn, 3]::INT[] AS places, (turn % 2)::INT AS label FROM conversations")
def schema_challenge_pairs(spark, sf_dir):
    c = B.read(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text"), F.col("role").alias("span1_text"), F.lit("it").alias("span2_text"), F.col("turn").cast("int").alias("span1_index"), F.lit(3).alias("span2_index"), (F.col("turn") % 2 == 1).alias("label"))
    return annotated.wsc_pairs(rows)


@query(f"""SELECT block, a, b, CASE WHEN (a + b) % 10 >= 5 THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN a % 4 = 0 THEN -1 ELSE (b % 4) / (a % 4)::DOUBLE END AS share FROM {B.PREDICTIONS}""")
def older_answers(spark, sf_dir):
    """Answers of a scorer by threshold, and shares of yes that are -1 where nothing valid was said."""
    p = B.predictions(spark, sf_dir).withColumn("score", (F.col("a") + F.col("b")) % 10).withColumn("yes", F.col("b") % 4).withColumn("valid", F.col("a") % 4)
    return p.select("block", "a", "b", predictors.threshold_answer("score", 5).alias("answer"), predictors.yes_share().alias("share"))


@query(f"SELECT mention, gold % 2 = 0 AS continuous FROM {B.MENTIONS} WHERE topic < 3 UNION ALL SELECT mention, gold % 2 = 0 FROM {B.MENTIONS} WHERE topic >= 3")
def joined_subsets(spark, sf_dir):
    """Subsets put together again, with their count checked; whether each mention's tokens follow each other."""
    m = B.mentions(spark, sf_dir).withColumn("t", F.when(F.col("gold") % 2 == 0, F.array("pos", F.col("pos") + 1)).otherwise(F.array("pos", F.col("pos") + 2)))
    cut = [m.where("topic < 3"), m.where("topic between 3 and 6"), m.where("topic > 6")]
    return filters.union_checked(cut, m.count()).select("mention", filters.is_continuous("t").alias("continuous"))


@query("""SELECT conv_id || '_1ecb' AS doc_id, m_id, sent_id::INT AS sent_id, tokens_str, mention_type, chain AS coref_chain, m_id <> '3' AS is_continuous, m_id = '3' AS is_singleton FROM (
  SELECT conv_id, '1' AS m_id, 0 AS sent_id, 'w0 w1' AS tokens_str, 'ACT' AS mention_type, 'chain ' || (conv_id % 3) AS chain FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, '2', 0, 'w2', 'HUM', 'INTRA_HUM_8_' || conv_id || '_1ecb' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, '3', 1, 'w3 w5', 'LOC', 'Singleton_LOC_3_' || conv_id || '_1ecb' FROM (SELECT DISTINCT conv_id FROM conversations))""")
def annotated_mentions(spark, sf_dir):
    """Mentions of annotated XML: spans, types, chains by relation, singletons; a document with bad numbers is left out whole."""
    d = B.read(spark, sf_dir, "conversations").select("conv_id").distinct()
    token = "".join(f'<token t_id="{i + 1}" sentence="{i // 3}" number="{i}">w{i}</token>' for i in range(6))
    marks = (
        '<Markables><ACTION_OCCURRENCE m_id="1"><token_anchor t_id="1"/><token_anchor t_id="2"/></ACTION_OCCURRENCE><HUMAN_PART_PER m_id="2"><token_anchor t_id="3"/></HUMAN_PART_PER>'
        '<LOC_GEO m_id="3"><token_anchor t_id="4"/><token_anchor t_id="6"/></LOC_GEO><ACTION_OCCURRENCE m_id="4" RELATED_TO="" TAG_DESCRIPTOR="t" instance_id="ACT1"/></Markables>'
    )
    text_ = F.concat(
        F.lit(f'<Document>{token}{marks}<Relations><CROSS_DOC_COREF r_id="7" note="chain '), (F.col("conv_id") % 3).cast("string"),
        F.lit('"><source m_id="1"/><target m_id="4"/></CROSS_DOC_COREF><INTRA_DOC_COREF r_id="8"><source m_id="2"/><target m_id="4"/></INTRA_DOC_COREF></Relations></Document>'),
    )
    files = d.select(F.concat(F.col("conv_id").cast("string"), F.lit("_1ecb.xml")).alias("name"), text_.alias("text"))
    bad = spark.createDataFrame([("bad_1ecb.xml", '<Document><token t_id="1" sentence="0" number="0">w</token><token sentence="x">w</token></Document>'), ("worse_1ecb.xml", "<Doc")], "name string, text string")
    t = annotated.tables(annotated.parse_annotations(files.unionByName(bad)))
    m = annotated.mentions_of(t["markables"], t["tokens"], t["relations"])
    return m.select("doc_id", "m_id", "sent_id", "tokens_str", "mention_type", "coref_chain", "is_continuous", "is_singleton")


@query(f"SELECT topic, mention, 'a \"q\", ' || chr(10) || gold AS note FROM {B.MENTIONS}")
def pair_csv_files(spark, sf_dir):
    """Rows written as CSV with a header, quotes and line ends in their cells, and read back."""
    m = B.mentions(spark, sf_dir).select("topic", "mention", F.concat(F.lit('a "q", \n'), F.col("gold").cast("string")).alias("note"))
    path = new_path(spark, "pair-csv")
    predictions.write_pairs(m, path, "csv")
    return spark.read.csv(path, header=True, escape='"', multiLine=True, schema="topic long, mention long, note string")


@query(f"SELECT count(DISTINCT topic) AS files, sum(length(mention::VARCHAR) + 1)::BIGINT AS bytes FROM {B.MENTIONS}")
def folder_of_files(spark, sf_dir):
    """Names and sizes of the files that an experiment leaves, one for each topic."""
    m = B.mentions(spark, sf_dir).select("topic", "mention")
    path = new_path(spark, "folder")
    m.repartition("topic").write.partitionBy("topic").csv(path)
    return predictions.folder(spark, f"{path}/topic=*").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@query(f"SELECT doc_id, string_agg(mention || ' é', chr(10) ORDER BY mention) || chr(10) AS text FROM {B.MENTIONS} GROUP BY doc_id")
def scanned_corpus(spark, sf_dir):
    """Texts of a corpus folder with a folder for each document."""
    m = B.mentions(spark, sf_dir).select("doc_id", "mention", F.concat(F.col("mention").cast("string"), F.lit(" é")).alias("value"))
    path = new_path(spark, "corpus")
    m.repartition("doc_id").sortWithinPartitions("doc_id", "mention").select("doc_id", "value").write.partitionBy("doc_id").text(path)
    found = annotated.scan_files(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long").alias("doc_id"), "text")
