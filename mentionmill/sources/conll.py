"""CoNLL key and response files: reading, document index, writing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_BEGIN = r"^#begin document \(?([^)\s]*)\)?"


def parse_document(lines: list[str]) -> list[tuple[int, int, str]]:
    """(begin, end, chain) of the mentions of one document's lines (last column: coreference)."""
    open_at: dict[str, list[int]] = {}
    out = []
    for i, line in enumerate(lines):
        cells = line.split()
        if not cells:
            continue
        for part in cells[-1].split("|"):
            m = re.fullmatch(r"(\()?([^()]+)(\))?", part)
            if not m or part == "-":
                continue
            opens, chain, closes = m.groups()
            if opens and closes:
                out.append((i, i, chain))
            elif opens:
                open_at.setdefault(chain, []).append(i)
            elif closes and open_at.get(chain):
                out.append((open_at[chain].pop(), i, chain))
    return sorted(out)


#: Documents that are parsed together.
DOCUMENTS = 500


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc, begin, end, chain`` of every mention; places are line numbers inside the document.

    Files are cut before the first lines of their documents, so a task takes some
    documents of a file and never a whole one.
    """

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), DOCUMENTS):
                rows = []
                for name, text in zip(pdf.file[lo : lo + DOCUMENTS], pdf.value[lo : lo + DOCUMENTS]):
                    doc, lines = None, []
                    # the cut takes the words from the first line of all documents but a file's first
                    for line in (text if text.startswith("#begin document") else f"#begin document{text}").splitlines():
                        if m := re.match(_BEGIN, line):
                            doc, lines = m.group(1), []
                        elif line.startswith("#end"):
                            rows += [(name, doc, *x) for x in parse_document(lines)]
                            doc, lines = None, []
                        elif doc is not None and not line.startswith("#") and line.strip():
                            lines.append(line)
                yield pd.DataFrame(rows, columns=["file", "doc", "begin", "end", "chain"])

    texts = spark.read.text(path, lineSep="\n#begin document").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return texts.mapInPandas(run, "file string, doc string, begin int, end int, chain string")


def document_index(lines: DataFrame) -> DataFrame:
    """First line of each document of a file (``file, line, value``)."""
    return lines.where(F.col("value").startswith("#begin document")).select("file", F.regexp_extract("value", _BEGIN, 1).alias("doc"), F.col("line").alias("begin_line"))


def one_token_mentions(lines: DataFrame) -> DataFrame:
    """Mentions of files with one mention a line, by pattern alone."""
    cell = F.regexp_extract("value", r"\(([^()|\s]+)\)\s*$", 1)
    return lines.select("*", cell.alias("chain")).where("chain <> ''")


def conll_lines(mentions: DataFrame, doc_name: str = "all") -> DataFrame:
    """``line, value`` of a mention-per-line file, chains numbered by first appearance in the file's order.

    ``mentions``: topic_id, doc_id, sent_id, start, mention, chain.  Mentions
    without a chain become chains of their own.
    """
    from ..operators.filters import conll_order, first_appearance, numbered

    placed = numbered(mentions, [*conll_order(), F.col("mention")], "line")
    chain = F.coalesce(F.col("chain").cast("string"), F.concat(F.lit("alone "), F.col("mention").cast("string")))
    numbered = first_appearance(placed.withColumn("_chain", chain), "_chain", "line")
    body = numbered.select(F.col("line").cast("int").alias("line"), F.concat_ws("\t", F.lit(doc_name), F.col("doc_id"), F.col("sent_id").cast("string"), F.col("mention").cast("string"), F.concat(F.lit("("), F.col("number").cast("string"), F.lit(")"))).alias("value"))
    spark = mentions.sparkSession
    head = spark.createDataFrame([(0, f"#begin document ({doc_name}); part 000"), (2**31 - 1, "#end document")], "line int, value string")
    return body.unionByName(head)


def write_conll(lines: DataFrame, path: str, one_file: bool = True) -> None:
    """Ordered text: one file, as readers of the format expect, or files whose names follow the order, written by as many tasks."""
    ordered = lines.orderBy("line").select("value")
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").text(path)
