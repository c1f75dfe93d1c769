"""Queries on text assembly, templates, prompts and CoNLL lines."""

from pyspark.sql import functions as F

from ..functions import templates, text
from ..operators import filters, pairs, predictors, stats
from ..sources import conll, predictions
from . import bindings as B
from .registry import query

_NB = "('''s', '.', '!', '?', ',', ';', ':', ')', ']', '}')"


def _sentence(tokens: str) -> str:
    """One sentence as text, in SQL."""
    return f"""(array_to_string([CASE WHEN t IN {_NB} THEN t ELSE ' ' || t END FOR t IN {tokens}], '') || CASE WHEN {tokens}[-1] IN ('.', '!', '?', '''''') THEN '' ELSE '.' END)"""


@query(f"SELECT doc_id, sent_id, tokens[2:4] AS x, array_to_string(tokens[2:4], ' ') AS text FROM {B.SENTENCES} WHERE len(tokens) >= 4")
def span_text(spark, sf_dir):
    s = B.sentences(spark, sf_dir).where("size(tokens) >= 4")
    return s.select("doc_id", "sent_id", F.slice("tokens", 2, 3).alias("x"), text.span_text("tokens", F.lit(1), F.lit(3)).alias("text"))


@query(f"SELECT doc_id, string_agg(array_to_string(tokens, ' '), ' @@@ ' ORDER BY sent_id) AS text FROM {B.SENTENCES} GROUP BY doc_id")
def raw_documents(spark, sf_dir):
    return text.raw_document(B.sentences(spark, sf_dir), ["doc_id"], "sent_id", "@@@")


#: Whole turns as mentions: (doc_id, sent_id, tokens) that have a token.
_WHOLE = f"(SELECT doc_id, sent_id, array_to_string(tokens, ' ') AS text FROM {B.SENTENCES} WHERE len(tokens) > 0)"
_PAIRS = f"""(SELECT x.doc_id * 1000000 + x.sent_id * 1000 + y.sent_id AS pair_id, x.doc_id, x.sent_id AS s1, y.sent_id AS s2, x.text AS m1, y.text AS m2
  FROM {_WHOLE} x JOIN {_WHOLE} y ON x.doc_id = y.doc_id AND x.sent_id < y.sent_id)"""


def _pairs(spark, sf_dir):
    """Pairs of turns of a conversation, each a mention from its first token to its last."""
    s = B.sentences(spark, sf_dir).where("size(tokens) > 0")
    m = s.select("doc_id", "sent_id", F.col("sent_id").alias("pos"), F.lit(0).alias("start"), (F.size("tokens") - 1).alias("end"), F.array_join("tokens", " ").alias("text"))
    p = pairs.within_block(m, "doc_id")
    pid = F.col("doc_id") * 1000000 + F.col("m1_pos") * 1000 + F.col("m2_pos")
    cols = [F.col(f"{m}_{a}").alias(f"{m}_{b}") for m in ("m1", "m2") for a, b in (("sent_id", "sent"), ("start", "start"), ("end", "end"), ("text", "text"))]
    return p.select(pid.alias("pair_id"), F.col("doc_id").alias("m1_doc"), F.col("doc_id").alias("m2_doc"), *cols)


def _turns(spark, sf_dir):
    return B.sentences(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("sent_id").alias("sent"), "tokens", (F.col("role") != "system").alias("selected"))


@query(f"""SELECT pair_id, replace(replace(trim(string_agg({_sentence("tokens")}, '' ORDER BY sent_id)), '`` ', '"'), ' ''''', '"') AS context
  FROM {_PAIRS} p JOIN {B.SENTENCES} s ON s.doc_id = p.doc_id AND s.sent_id BETWEEN p.s1 AND p.s2 GROUP BY pair_id""")
def context_middle(spark, sf_dir):
    """The mentions' sentences and those between them."""
    return text.pair_contexts(_pairs(spark, sf_dir), _turns(spark, sf_dir), "middle")


@query(f"""SELECT pair_id, replace(replace(trim(string_agg({_sentence("tokens")}, '' ORDER BY sent_id)), '`` ', '"'), ' ''''', '"') AS context
  FROM {_PAIRS} p JOIN {B.SENTENCES} s ON s.doc_id = p.doc_id AND s.sent_id <= p.s2 AND s.role <> 'system' GROUP BY pair_id""")
def context_document(spark, sf_dir):
    """From the document's beginning to the later mention, selected sentences only."""
    return text.pair_contexts(_pairs(spark, sf_dir), _turns(spark, sf_dir), "doc", selected_only=True)


@query(f"""WITH t AS (SELECT pair_id, s.sent_id, ' <mention>' || array_to_string([CASE WHEN t IN {_NB} THEN t ELSE ' ' || t END FOR t IN tokens], '') || ' </mention>'
    || CASE WHEN tokens[-1] IN ('.', '!', '?', '''''') THEN '' ELSE '.' END AS x FROM {_PAIRS} p JOIN {B.SENTENCES} s ON s.doc_id = p.doc_id AND s.sent_id IN (p.s1, p.s2))
  SELECT pair_id, replace(replace(trim(string_agg(x, ' $$' ORDER BY sent_id)), '`` ', '"'), ' ''''', '"') AS context FROM t GROUP BY pair_id""")
def context_marked(spark, sf_dir):
    """The mentions' sentences with both mentions marked, parts divided by a sign."""
    return text.pair_contexts(_pairs(spark, sf_dir), _turns(spark, sf_dir), "sent", mark=True, splitter=" $$")


@query(f"""WITH c AS (SELECT pair_id, any_value(m1) AS m1, any_value(m2) AS m2, replace(replace(trim(string_agg({_sentence("tokens")}, '' ORDER BY sent_id)), '`` ', '"'), ' ''''', '"') AS context
    FROM {_PAIRS} p JOIN {B.SENTENCES} s ON s.doc_id = p.doc_id AND s.sent_id BETWEEN p.s1 AND p.s2 GROUP BY pair_id)
  SELECT pair_id, '22MAU' AS template_id, '''' || context || ''' Here, does ''' || m2 || ''' stand for ''' || m1 || '''? Yes or no? ' AS prompt FROM c
  UNION ALL SELECT pair_id, '24MAU', '''' || context || ''' I think ''' || m2 || ''' means ''' || m1 || '''. Yes or no?' FROM c""")
def prompts(spark, sf_dir):
    """Prompts of every pair under two templates."""
    p = _pairs(spark, sf_dir)
    c = text.pair_contexts(p, _turns(spark, sf_dir), "middle").join(p.select("pair_id", "m1_text", "m2_text"), "pair_id")
    t = templates.templates(spark).where(F.col("template_id").isin("22MAU", "24MAU")).select("template_id", "body")
    filled = c.crossJoin(F.broadcast(t))  # a template table of fixed size
    prompt = text.fill_template("body", {"M_CONTEXT": "context", "MENTION1": "m1_text", "MENTION2": "m2_text"})
    return filled.select("pair_id", "template_id", prompt.alias("prompt"))


@query("SELECT 26::BIGINT AS n, 0::INT AS first, 26::INT AS last")
def template_table(spark, sf_dir):
    return templates.templates(spark).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"), F.max("number").alias("last"))


@query(f"""SELECT doc_id, string_agg('Q: ' || array_to_string(tokens, ' ') || ' A: ' || len(tokens), chr(10) ORDER BY sent_id) AS prefix FROM {B.SENTENCES} GROUP BY doc_id""")
def few_shot_prefix(spark, sf_dir):
    """Every turn of a conversation as a worked example."""
    s = B.sentences(spark, sf_dir)
    rows = s.select("doc_id", "sent_id", F.concat(F.lit("Q: "), F.array_join("tokens", " ")).alias("prompt"), F.concat(F.lit("A: "), F.size("tokens").cast("string")).alias("answer"))
    return text.few_shot_prompt(rows, ["doc_id"], "sent_id")


def _untok(rules) -> str:
    """The rules applied to ``t``, in SQL."""
    out = "t"
    for kind, a, b in rules:
        qa, qb = (x.replace("'", "''") for x in (a, b))
        out = f"replace({out}, '{qa}', '{qb}')" if kind == "s" else f"regexp_replace({out}, '{qa}', '{qb.replace('$', chr(92))}', 'g')"
    return out


_UNTOK = _untok(text.UNTOKENIZE)
_SOURCE = f"""(SELECT doc_id, sent_id, regexp_replace(array_to_string(tokens, ' '), '([.,])', ' \\1', 'g') || ' `` a b '' . . . ( c ) can not do n''t p. m. " x "' AS t FROM {B.SENTENCES})"""


@query(f"""SELECT doc_id, sent_id, {_UNTOK} AS text FROM (SELECT doc_id, sent_id, regexp_replace(array_to_string(tokens, ' '), '([.,])', ' \\1', 'g') || ' `` a b '' . . . ( c ) can not do n''t p. m. " x "' AS t FROM {B.SENTENCES})""")
def untokenized(spark, sf_dir):
    """Token text with punctuation put back."""
    t = F.concat(F.regexp_replace(F.array_join("tokens", " "), "([.,])", " $1"), F.lit(" `` a b '' . . . ( c ) can not do n't p. m. \" x \"".replace(" ''", " '")))
    return B.sentences(spark, sf_dir).select("doc_id", "sent_id", text.untokenize(t).alias("text"))


@query(f"""SELECT doc_id, sent_id, {_untok(text.UNTOKENIZE_OLDER)} AS text FROM {_SOURCE}""")
def untokenized_by_older_rules(spark, sf_dir):
    """The same text by the rules of the older generation."""
    t = F.concat(F.regexp_replace(F.array_join("tokens", " "), "([.,])", " $1"), F.lit(" `` a b '' . . . ( c ) can not do n't p. m. \" x \"".replace(" ''", " '")))
    return B.sentences(spark, sf_dir).select("doc_id", "sent_id", text.untokenize(t, rules=text.UNTOKENIZE_OLDER).alias("text"))


@query("""SELECT page_id, CASE WHEN length(url) > 10 AND regexp_matches(url, '(Jan|May|Video|[.]html)') THEN regexp_extract(url, '^(.*?)(Jan|May|Video|[.]html)', 1) || ' ' || regexp_extract(url, '^(.*?)(Jan|May|Video|[.]html)', 2) ELSE
  regexp_extract(url, '^(?:http|ftp|https)://[A-Za-z0-9_-]+(?:[.][A-Za-z0-9_-]+)+[A-Za-z0-9_.,@?^=%&:/~+#-]*[A-Za-z0-9_@?^=%&/~+#-]') END || ' x' AS text FROM (SELECT page_id, split_part(url, '?', 1) || 'May' AS url FROM pages WHERE url NOT LIKE '%#%')""")
def leading_address_split(spark, sf_dir):
    """A leading address cut before the word that ran into it."""
    p = B.read(spark, sf_dir, "pages").where("url not like '%#%'")
    t = F.concat(F.split("url", r"\?")[0], F.lit("May x"))
    return p.select("page_id", text.split_address(t).alias("text"))


@query(f"""WITH f AS (SELECT doc_id, sent_id * 1000 + i AS o, tokens[i] AS token, CASE WHEN length(tokens[i]) > 6 THEN length(tokens[i]) % 3 END AS tag FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM {B.SENTENCES})),
  g AS (SELECT *, lag(tag) OVER w AS b, lead(tag) OVER w AS a FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY o))
  SELECT doc_id, string_agg((CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM b THEN '{{tag_id:' || tag || ' ' ELSE '' END) || token || (CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM a THEN ' }}' ELSE '' END), ' ' ORDER BY o) AS text FROM g GROUP BY doc_id""")
def tagged_text(spark, sf_dir):
    """Runs of one cluster wrapped in place."""
    f = B.sentences(spark, sf_dir).select("doc_id", "sent_id", F.posexplode("tokens").alias("i", "token"))
    rows = f.select("doc_id", (F.col("sent_id") * 1000 + F.col("i") + 1).alias("o"), "token", F.when(F.length("token") > 6, F.length("token") % 3).alias("tag"))
    return text.tagged_text(rows, ["doc_id"], "o")


@query(f"""SELECT doc_id, sent_id, ltrim(array_to_string([CASE WHEN regexp_matches(t, '^[.,:;?!%)\\]}}'']') THEN '' ELSE ' ' END || t FOR t IN tokens], '')) AS text FROM {B.SENTENCES}""")
def plain_text_rebuilt(spark, sf_dir):
    return B.sentences(spark, sf_dir).select("doc_id", "sent_id", text.plain_with_punctuation("tokens").alias("text"))


@query(f"""SELECT x.mention AS a, y.mention AS b, round(greatest(0, list_sum([x.vector[i]::DOUBLE * y.vector[i]::DOUBLE FOR i IN range(1, 65)]) / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN x.vector]))
  / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN y.vector]))) * 100, 6) AS similarity FROM {B.MENTIONS} x JOIN {B.MENTIONS} y ON x.doc_id = y.doc_id AND x.pos < y.pos""")
def mention_similarity(spark, sf_dir):
    p = pairs.similar_pairs(B.mentions(spark, sf_dir, vector=True).select("doc_id", "mention", "pos", "vector"), "doc_id")
    return B.rounded(p.select(F.col("m1_mention").alias("a"), F.col("m2_mention").alias("b"), "similarity"))


@query(f"""SELECT gold, [round(avg(vector[i]::DOUBLE) , 5) FOR i IN [1]][1] AS x1 FROM {B.MENTIONS} GROUP BY gold""".replace("[round(avg(vector[i]::DOUBLE) , 5) FOR i IN [1]][1]", "round(avg(vector[1]::DOUBLE), 5)"))
def mean_vectors(spark, sf_dir):
    """Elementwise means of each gold tag's vectors; the first component is shown."""
    m = stats.mean_vector(B.mentions(spark, sf_dir, vector=True).withColumn("vector", F.transform("vector", lambda x: x.cast("double"))), ["gold"])
    return m.select("gold", F.round(F.col("vector")[0], 5).alias("x1"))


@query()
def fuzzy_similarity(spark, sf_dir):
    """Matching-block similarity of mention texts; its matcher is sequential, so SQL has no form."""
    p = _pairs(spark, sf_dir)
    return p.select("pair_id", text.fuzzy_ratio("m1_text", "m2_text").alias("fuzzy"))


@query("""SELECT event_id, (props::JSON->>'$.k')::INT AS k, [event_id % 5, 5]::INT[] AS votes, 'a' AS one, 'b;c' AS two FROM events""")
def parsed_fields(spark, sf_dir):
    """JSON properties, vote texts and two-part texts."""
    e = B.read(spark, sf_dir, "events")
    votes = text.parse_counts(F.concat(F.lit("["), (F.col("event_id") % 5).cast("string"), F.lit(", 5]")))
    one, two = text.split_two(F.lit("a;b;c"))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), votes.alias("votes"), one.alias("one"), two.alias("two"))


@query(f"""SELECT doc_id, sent_id, (SELECT count(*) FROM (SELECT unnest([2, 4, 6]) AS d) WHERE d <= sent_id)::INT AS part, regexp_replace('36_' || doc_id || 'ecb', '_[0-9]+', '_') AS sub FROM {B.SENTENCES}""")
def dividers_and_subtopics(spark, sf_dir):
    s = B.sentences(spark, sf_dir)
    doc = F.concat(F.lit("36_"), F.col("doc_id").cast("string"), F.lit("ecb"))
    return s.select("doc_id", "sent_id", text.sentence_of("sent_id", F.array(F.lit(2), F.lit(4), F.lit(6))).alias("part"), filters.doc_to_subtopic(doc).alias("sub"))


_NAME = """'M' || (doc_id % 3) || '_35-10ecb_shot' || (doc_id % 4) || '(ecb)_beam1_noSample(t0.' || (doc_id % 10) || 'r' || (doc_id % 5) || ')[p1-p5].csv'"""


@query("""SELECT doc_id, 'M' || (doc_id % 3) AS model, '35-10ecb' AS data, (doc_id % 4)::VARCHAR AS shots, '0.' || (doc_id % 10) AS temperature, (doc_id % 5)::VARCHAR AS repeats FROM labels""")
def file_name_settings(spark, sf_dir):
    """Experiment settings read from result file names, all digits of the temperature kept."""
    d = F.col("doc_id")
    name = F.format_string("M%d_35-10ecb_shot%d(ecb)_beam1_noSample(t0.%dr%d)[p1-p5].csv", d % 3, d % 4, d % 10, d % 5)
    s = B.read(spark, sf_dir, "labels").select("doc_id", predictions.settings(name).alias("s"))
    return s.select("doc_id", *[f"s.{c}" for c in ("model", "data", "shots", "temperature", "repeats")])


@query(f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY (gold > 6)::INT, topic::VARCHAR, doc_id::VARCHAR, sent_id, pos DESC, mention) AS line FROM (SELECT *, gold || '_' || topic AS chain FROM {B.MENTIONS})),
  f AS (SELECT chain, row_number() OVER (ORDER BY min(line), chain) - 1 AS n FROM l GROUP BY chain)
  SELECT line::INT AS line, 'all' || chr(9) || (doc_id || CASE WHEN gold > 6 THEN 'ecbplus' ELSE 'ecb' END) || chr(9) || sent_id || chr(9) || mention || chr(9) || '(' || n || ')' AS value FROM l JOIN f USING (chain)
  UNION ALL SELECT 0, '#begin document (all); part 000' UNION ALL SELECT 2147483647, '#end document'""".replace("doc_id::VARCHAR, sent_id", "(doc_id || CASE WHEN gold > 6 THEN 'ecbplus' ELSE 'ecb' END), sent_id"))
def conll_lines(spark, sf_dir):
    """Mention-per-line file: ordered lines, chains numbered by first appearance."""
    m = B.mentions(spark, sf_dir)
    doc = F.concat(F.col("doc_id").cast("string"), F.when(F.col("gold") > 6, "ecbplus").otherwise("ecb"))
    rows = m.select(F.col("topic").cast("string").alias("topic_id"), doc.alias("doc_id"), "sent_id", F.col("pos").alias("start"), "mention", F.concat_ws("_", F.col("gold").cast("string"), F.col("topic").cast("string")).alias("chain"))
    return conll.conll_lines(rows)


@query(f"""SELECT pair_id, count(*) FILTER (x = 'Yes') AS yes, 3::BIGINT AS valid, 3::BIGINT AS repeat FROM (SELECT pair_id, CASE WHEN contains(array_to_string(tokens, ' '), 'the') THEN 'Yes' ELSE 'No' END AS x
  FROM {_PAIRS} p JOIN {B.SENTENCES} s ON s.doc_id = p.doc_id AND s.sent_id = p.s1 CROSS JOIN range(3)) GROUP BY pair_id""")
def predictor_votes(spark, sf_dir):
    """A predictor asked three times for every prompt, its answers counted."""
    from ..operators.metrics import vote_counts

    s = B.sentences(spark, sf_dir).select("doc_id", F.col("sent_id").alias("m1_sent"), F.array_join("tokens", " ").alias("prompt"))
    p = _pairs(spark, sf_dir).select("pair_id", F.col("m1_doc").alias("doc_id"), "m1_sent").join(s, ["doc_id", "m1_sent"]).select("pair_id", "prompt")
    return vote_counts(predictors.predict(p, predictors.create("keyword", "the"), repeat=3), ["pair_id"])


@query(f"""SELECT temperature, count(*) AS n FROM {_PAIRS} CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS temperature) GROUP BY temperature""")
def temperature_sweep(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("pair_id", F.col("m1_text").alias("prompt"))
    got = predictors.predict(p, predictors.create("keyword", "e"), temperatures=(0.2, 0.4, 0.6, 0.8, 1.0))
    return got.groupBy("temperature").agg(F.count("answer").alias("n"))


@query(f"SELECT x.doc_id AS block, x.mention AS a, y.mention AS b, CASE WHEN x.gold = y.gold THEN 'Yes' ELSE 'No' END AS answer, 1.0::DOUBLE AS right_share FROM {B.MENTIONS} x JOIN {B.MENTIONS} y ON x.doc_id = y.doc_id AND x.pos < y.pos")
def ground_truth_predictor(spark, sf_dir):
    """The predictor that is always right scores perfectly."""
    p = B.predictions(spark, sf_dir).withColumn("label", F.col("truth").cast("int"))
    right = F.when(F.col("label") == 1, F.col("answer") == "Yes").otherwise(F.col("answer") == "No")
    return p.withColumn("answer", predictors.ground_truth()).select("block", "a", "b", "answer", right.cast("double").alias("right_share"))
