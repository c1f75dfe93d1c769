"""Table functions for SQL text: markables of annotated documents, and chains of scored pairs.

``register(spark)`` makes them known to a session::

    SELECT * FROM markables(TABLE(docs) PARTITION BY name)
    SELECT * FROM assign_chains(TABLE(pairs) PARTITION BY (block), 0.5)

Both take a partitioned table: the rows of a partition come to one instance, and
what it holds is one document at a time, or the union-find of one block.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from ..operators.filters import TAG_TYPES
from ..operators.graph import lowest
from ..sources.annotated import _document


def _column(argument: AnalyzeArgument, name: str):
    """Type of a column of a table argument; an error that names it where it is missing."""
    if not argument.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ...")
    found = {f.name.lower(): f.dataType for f in argument.dataType.fields}
    if name not in found:
        raise ValueError(f"the table has no column {name}")
    return found[name]


def _type(tag: str) -> str | None:
    """``tag_to_type`` of one tag."""
    return "UNK" if tag == "UNKNOWN_INSTANCE_TAG" else next((kind for part, kind in TAG_TYPES if part in tag), None)


@udtf
class Markables:
    """``doc_id, m_id, sent_id, tokens_ids, tokens_number, tokens_str, mention_type, coref_chain, is_continuous, is_singleton`` of XML documents (``name, text``).

    The rows that ``mentions_of`` gives for parsed tables.  A document that is no
    XML, or whose numbers are none, gives no row.  Null texts are no documents.
    """

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        for name in ("name", "text"):
            _column(docs, name)
        numbers = ArrayType(IntegerType())
        schema = StructType()
        for name, kind in (
            ("doc_id", StringType()), ("m_id", StringType()), ("sent_id", IntegerType()), ("tokens_ids", numbers), ("tokens_number", numbers), ("tokens_str", StringType()),
            ("mention_type", StringType()), ("coref_chain", StringType()), ("is_continuous", BooleanType()), ("is_singleton", BooleanType()),
        ):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema)

    def eval(self, row):
        if row["name"] is None or row["text"] is None:
            return
        doc = row["name"].rsplit(".", 1)[0]
        try:
            rows = _document(doc, row["text"])
        except (ET.ParseError, AttributeError, TypeError, ValueError):
            return
        tokens = {r["t_id"]: r for r in rows if r["level"] == "token"}
        relation = {}
        for r in rows:
            if r["level"] == "relation":
                for m in r["sources"]:
                    relation.setdefault(m, r)
        for m in rows:
            if m["level"] != "markable" or m["related_to"] is not None:
                continue
            own = [tokens[t] for t in m["anchors"] if t in tokens]
            if not own:
                continue
            kind, r = _type(m["tag"]), relation.get(m["m_id"])
            if r is None:
                chain = f"Singleton_{kind or 'null'}_{m['m_id']}_{doc}"
            else:
                chain = f"INTRA_{kind or 'null'}_{r['r_id']}_{doc}" if r["kind"].startswith("INTRA") else r["note"]
            numbers = [t["number"] for t in own]
            yield (
                doc, m["m_id"], own[0]["sent_id"], [t["t_id"] for t in own], numbers, " ".join(t["token"] for t in own), kind, chain,
                any(numbers == list(range(numbers[0], numbers[-1] + step, step)) for step in (1, -1)), None if chain is None else "Singleton" in chain,
            )


@udtf
class AssignChains:
    """``block, mention, cluster`` from scored pairs (``block, a, b, score``) and a threshold; a chain goes by its smallest mention.

    The rows that ``cluster`` gives; memory follows the mentions of a block.
    """

    @staticmethod
    def analyze(pairs: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        block, kind = _column(pairs, "block"), _column(pairs, "a")
        if _column(pairs, "b") != kind:
            raise ValueError("a and b are of different types")
        _column(pairs, "score")
        return AnalyzeResult(StructType().add("block", block).add("mention", kind).add("cluster", kind))

    def __init__(self):
        self.block, self.root = None, {}

    def _top(self, m):
        top = m
        while (up := self.root.setdefault(top, top)) != top:
            top = up
        while m != top:
            self.root[m], m = top, self.root[m]
        return top

    def eval(self, row, threshold):
        self.block = row["block"]
        if row["a"] is None or row["b"] is None:
            return
        x, y = self._top(row["a"]), self._top(row["b"])
        score = row["score"]
        if score is not None and score >= threshold and x != y:
            self.root[max(x, y)] = min(x, y)

    def terminate(self):
        for m in list(self.root):
            yield self.block, m, self._top(m)


#: Pairs that a task reduces at once.
HELD = 1 << 18


def _reduced(t: pa.Table, threshold: float) -> pa.RecordBatch:
    """A row for each mention of some pairs: linked to the smallest mention of its chain, or a pair of itself."""
    t = t.filter(pc.and_(pc.is_valid(t["a"]), pc.is_valid(t["b"])))
    code = t["block"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("a", "b")])
    names, at = np.unique(ends, return_inverse=True)
    u, v = (code * len(names) + x for x in (at[: len(code)], at[len(code) :]))
    linked = pc.fill_null(pc.greater_equal(t["score"], threshold), False).to_numpy()
    node, low = lowest(u[linked], v[linked])
    alone = np.setdiff1d(np.concatenate([u, v]), node)
    node, low = np.concatenate([node, alone]), np.concatenate([low, alone])
    kept, first = np.unique(code, return_index=True)
    count = max(1, len(names))
    block = t["block"].take(pa.array(first[np.searchsorted(kept, node // count)])).combine_chunks()
    a, b = (pa.array(names[x % count] if len(names) else [], t.schema.field("a").type) for x in (node, low))
    score = pa.array(np.full(len(node), float(threshold)), pa.float64(), mask=node == low)
    return pa.record_batch([block, a, b, score], names=["block", "a", "b", "score"])


def reduced_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Far fewer scored pairs of the same mentions and chains at ``threshold``, for ``assign_chains``, which takes one row at a time.

    Tasks reduce every ``HELD`` of their pairs to one row for each mention.
    """
    kinds = dict(pairs.dtypes)
    rows = pairs.select("block", "a", "b", pairs["score"].cast("double").alias("score"))

    def each(batches):
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= HELD:
                yield _reduced(pa.Table.from_batches(held), threshold)
                held, size = [], 0
        if held:
            yield _reduced(pa.Table.from_batches(held), threshold)

    return rows.mapInArrow(each, f"block {kinds['block']}, a {kinds['a']}, b {kinds['b']}, score double")


def register(spark: SparkSession) -> None:
    spark.udtf.register("markables", Markables)
    spark.udtf.register("assign_chains", AssignChains)
