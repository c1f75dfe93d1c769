"""Sources of annotated corpora: XML documents, token tables, selections, JSON mentions, lists."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schemas import GOLD_CONLL, MARKABLES, RELATIONS, SELECTED, TOKENS

#: Columns of one parsed annotation row; ``level`` says which of the three tables it belongs to.
_FLAT = (
    "level string, doc_id string, t_id int, sent_id int, number int, token string, m_id string, tag string, anchors array<int>, "
    "related_to string, tag_descriptor string, instance_id string, r_id string, kind string, note string, sources array<string>, target string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(x.split(" ")[0], _KINDS[x.split(" ")[1]]) for x in _FLAT.split(", ")])


def scan_files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """``path, name, text`` of the files of a folder and its topic folders; one task reads many small files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.decode("content", "UTF-8").alias("text"))


def _document(doc: str, text: str) -> list[dict]:
    """Rows of one document."""
    root, rows = ET.fromstring(text.encode()), []
    for t in root.iter("token"):
        rows.append({"level": "token", "doc_id": doc, "t_id": int(t.get("t_id")), "sent_id": int(t.get("sentence")), "number": int(t.get("number")), "token": t.text or ""})
    for m in [x for p in root.iter("Markables") for x in p]:
        rows.append({
            "level": "markable", "doc_id": doc, "m_id": m.get("m_id"), "tag": m.tag, "anchors": [int(a.get("t_id")) for a in m.findall("token_anchor")],
            "related_to": m.get("RELATED_TO"), "tag_descriptor": m.get("TAG_DESCRIPTOR"), "instance_id": m.get("instance_id"),
        })
    for r in [x for p in root.iter("Relations") for x in p]:
        target = r.find("target")
        rows.append({
            "level": "relation", "doc_id": doc, "r_id": r.get("r_id"), "kind": r.tag, "note": r.get("note"),
            "sources": [s.get("m_id") for s in r.findall("source")], "target": None if target is None else target.get("m_id"),
        })
    return rows


def parse_annotations(files: DataFrame) -> DataFrame:
    """Tokens, markables and relations of XML texts (``name, text``) in one flat table.

    Element names of markables are data, so a document is parsed as a tree; one
    that is no XML or lacks a number gives a row of level ``error`` alone, with the
    message as token.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = name.rsplit(".", 1)[0]
                try:
                    rows += _document(doc, text)
                except (ET.ParseError, AttributeError, TypeError, ValueError) as e:  # no XML, or numbers that are none
                    rows.append({"level": "error", "doc_id": doc, "token": str(e)})
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[lo : lo + 10_000], schema=_ARROW)

    return files.select("name", "text").mapInArrow(run, _FLAT)


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a corpus, and its unreadable documents."""
    pick = lambda level, schema: flat.where(F.col("level") == level).select(*schema.fieldNames())
    return {
        "tokens": pick("token", TOKENS), "markables": pick("markable", MARKABLES), "relations": pick("relation", RELATIONS),
        "errors": flat.where("level = 'error'").select("doc_id", F.col("token").alias("message")),
    }


def corpus_documents(files: DataFrame) -> DataFrame:
    """Topic, sub-topic and kind of each document name."""
    doc = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.select(
        doc.alias("doc_id"), F.regexp_extract(doc, "^([0-9]+)_", 1).cast("int").alias("topic"), F.regexp_replace(doc, "_[0-9]+", "_").alias("topic_id"),
        doc.contains("plus").alias("is_plus"),
    )


def mentions_of(markables: DataFrame, tokens: DataFrame, relations: DataFrame) -> DataFrame:
    """Mention rows: token span and text, type, chain, continuity; chains by relation, else a singleton's id."""
    from ..operators.filters import is_continuous, tag_to_type

    real = markables.where("related_to is null and size(anchors) > 0")
    flat = real.select("doc_id", "m_id", "tag", F.posexplode("anchors").alias("at", "t_id")).join(tokens, ["doc_id", "t_id"])
    part = F.struct("at", "t_id", "number", "sent_id", "token")
    spans = flat.groupBy("doc_id", "m_id", "tag").agg(F.array_sort(F.collect_list(part)).alias("p"))
    rel = relations.select("doc_id", F.explode("sources").alias("m_id"), "kind", "note", "r_id").dropDuplicates(["doc_id", "m_id"])
    kind = tag_to_type("tag")
    chain = (
        F.when(F.col("kind").startswith("INTRA"), F.format_string("INTRA_%s_%s_%s", kind, "r_id", "doc_id"))
        .when(F.col("kind").isNotNull(), F.col("note")).otherwise(F.format_string("Singleton_%s_%s_%s", kind, "m_id", "doc_id"))
    )
    numbers = F.transform("p", lambda x: x["number"])
    out = spans.join(rel, ["doc_id", "m_id"], "left").select(
        "doc_id", "m_id", F.col("p")[0]["sent_id"].alias("sent_id"), numbers.alias("tokens_number"), F.transform("p", lambda x: x["t_id"]).alias("tokens_ids"),
        F.array_join(F.transform("p", lambda x: x["token"]), " ").alias("tokens_str"), kind.alias("mention_type"), chain.alias("coref_chain"),
    )
    return out.withColumn("is_continuous", is_continuous("tokens_number")).withColumn("is_singleton", F.col("coref_chain").contains("Singleton"))


def clean_tokens(tokens: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Tokens without listed bad ones and replacement characters; the last of each sentence but the document's last gets ``[EOS]``."""
    kept = tokens.join(bad.select("doc_id", "t_id"), ["doc_id", "t_id"], "left_anti") if bad is not None else tokens
    after = F.lead("sent_id").over(Window.partitionBy("doc_id").orderBy("t_id"))
    text = F.trim(F.replace("token", F.lit("�"), F.lit("")))
    return kept.withColumn("token", F.when(after != F.col("sent_id"), F.concat(text, F.lit(" [EOS]"))).otherwise(text))


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated tokens ``doc_id, sent_id, number, token, chain``; empty cells are dropped, blank lines skipped."""
    cells = F.filter(F.split("value", "\t"), lambda x: x != "")
    rows = spark.read.text(path).where(F.trim("value") != "").select(cells.alias("c")).where(F.size("c") >= 5)
    at = lambda i: F.get("c", F.lit(i))
    return rows.select(at(0).alias("doc_id"), at(1).cast("int").alias("sent_id"), at(2).cast("int").alias("number"), at(3).alias("token"), at(4).alias("chain"))


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, sent_id`` of the selected sentences."""
    rows = spark.read.csv(path, header=True, schema=SELECTED)
    return rows.select(F.concat_ws("_", F.col("topic").cast("string"), F.regexp_replace("file", r"\.xml$", "")).alias("doc_id"), F.col("sentence").alias("sent_id"))


def read_json_mentions(spark: SparkSession, path: str, schema=GOLD_CONLL) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a list (pronouns), without blanks and comments."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text vectors: a word and its numbers, separated by blanks."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(
        F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vector")
    )


def wsc_pairs(rows: DataFrame) -> DataFrame:
    """Pair rows of a schema-challenge table (``text, span1_text, span2_text, span1_index, span2_index, label``)."""
    return rows.select("text", F.array("span1_text", "span2_text").alias("pair"), F.array("span1_index", "span2_index").alias("places"), F.col("label").cast("int").alias("label"))
