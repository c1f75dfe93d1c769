"""A data source of coreference files: ``spark.read.format("conll")`` and ``df.write.format("conll")``.

Reading: ``file, doc, begin, end, chain``, a row for each mention, as
``read_conll`` gives them.  A file of any size is cut into ranges of
``rangeBytes``; a task reads the documents whose first line begins in its range,
line by line and to their end, so a document is read once and by one task, and no
more than one is held.  Filters on ``file`` leave out files, filters on ``doc``
skip documents before their lines are parsed (equality and lists; see
``register``).  A document without an end line is none.  Compressed files are not
cut and not read.

Writing: rows ``doc, begin, end, chain`` with the rows of a document next to each
other (``write_mentions`` sees to that).  Each task writes one file under a trial
name; the driver gives the files their names when all tasks are done, and takes
them away if one fails.  Spans of one chain that cross cannot be told apart in
this format: such a document is an error, and so is a chain that is empty, ``-``
or holds a bracket, a bar or white space.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .conll import _BEGIN, parse_document

RANGE_BYTES, ROWS = 8 << 20, 10_000
_SCHEMA = pa.schema([("file", pa.string()), ("doc", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("chain", pa.string())])


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


class ConllReader(DataSourceReader):
    def __init__(self, path: str, size: int, files: set[str] | None = None, docs: set[str] | None = None):
        self.path, self.size, self.files, self.docs = path, size, files, docs

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(x[:1] in "._" for x in f.path[len(root) :].split("/") if x)
            if f.type != fs.FileType.File or hidden or (self.files is not None and f.base_name not in self.files):
                continue
            out += [Range(f.path, a, min(a + self.size, f.size)) for a in range(0, f.size, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        rows, name = [], partition.file.rsplit("/", 1)[-1]
        for doc, lines in documents(store, partition, self.docs):
            rows += [(name, doc, *x) for x in parse_document(lines)]
            while len(rows) >= ROWS:
                yield pa.record_batch([list(c) for c in zip(*rows[:ROWS])], schema=_SCHEMA)
                rows = rows[ROWS:]
        if rows:
            yield pa.record_batch([list(c) for c in zip(*rows)], schema=_SCHEMA)


def documents(store, part: Range, only: set[str] | None) -> Iterator[tuple[str, list[str]]]:
    """(name, lines) of the documents whose first line begins in the range."""
    with store.open_input_file(part.file) as raw:
        at = part.begin
        if at:  # the line that begins before the range belongs to the range before
            raw.seek(at - 1)
        with pa.input_stream(raw, buffer_size=1 << 16) as f:
            rest = b""
            if at:
                first, rest = _line(f, b"")
                at += len(first) - 1
            doc, lines, keep = None, [], False
            while True:
                line, rest = _line(f, rest)
                if not line:
                    return
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if m := re.match(_BEGIN, text):
                    if at >= part.end:
                        return
                    doc, lines = m.group(1), []
                    keep = only is None or doc in only
                elif doc is None:
                    if at >= part.end:
                        return
                elif text.startswith("#end"):
                    if keep:
                        yield doc, lines
                    doc = None
                elif keep and not text.startswith("#") and text.strip():
                    lines.append(text)
                at += len(line)


def _line(f, rest: bytes) -> tuple[bytes, bytes]:
    """The next line with its end, and what has been read beyond it."""
    parts = [rest]
    while b"\n" not in parts[-1]:
        more = f.read(1 << 16)
        if not more:
            return b"".join(parts), b""
        parts.append(more)
    whole = b"".join(parts)
    cut = whole.index(b"\n") + 1
    return whole[:cut], whole[cut:]


def document_lines(doc: str, mentions: list[tuple[int, int, str]]) -> list[str]:
    """Lines of a document; those of one place in the order close, single, open, so that spans that only touch stay apart."""
    cells: dict[int, tuple[list, list, list]] = {}
    for begin, end, chain in sorted(mentions, key=lambda m: (m[0], -m[1], m[2])):
        if not re.fullmatch(r"[^()|\s]+", chain) or chain == "-" or not 0 <= begin <= end:
            raise ValueError(f"{doc}: not a mention of this format: {(begin, end, chain)}")
        at = lambda i: cells.setdefault(i, ([], [], []))
        if begin == end:
            at(begin)[1].append(f"({chain})")
        else:
            at(begin)[2].append(f"({chain}")
            at(end)[0].append(f"{chain})")
    last = max((end for _, end, _ in mentions), default=-1)
    lines = [f"{doc}\t{i}\t{'|'.join(x for part in cells[i] for x in part) if i in cells else '-'}" for i in range(last + 1)]
    if parse_document(lines) != sorted(mentions):
        raise ValueError(f"{doc}: spans of one chain cross")
    return lines


@dataclass
class Written(WriterCommitMessage):
    trial: str
    name: str


class ConllWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names, self.run = path, overwrite, names, uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.run}.conll"
        trial = f"{root}/_trial-{uuid.uuid4().hex}"
        doc, mentions, n = None, [], 0
        try:
            with store.open_output_stream(trial) as f:

                def put() -> None:
                    text = "\n".join([f"#begin document ({doc}); part 000", *document_lines(doc, mentions), "", "#end document", ""])
                    f.write(text.encode())

                for row in iterator:
                    own, begin, end, chain = (row[c] for c in ("doc", "begin", "end", "chain"))
                    if own != doc and doc is not None:
                        put()
                        mentions = []
                    doc, n = own, n + 1
                    mentions.append((begin, end, chain))
                if doc is not None:
                    put()
        except BaseException:
            store.delete_file(trial)
            raise
        if not n:
            store.delete_file(trial)
        return Written(trial if n else "", f"{root}/{name}")

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)) if self.overwrite and f.path.endswith(".conll")]
        for m in messages:
            if m and m.trial:
                store.move(m.trial, m.name)
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.trial:
                store.delete_file(m.trial)


class ConllDataSource(DataSource):
    """Options: ``path`` (file or folder), ``rangeBytes``, ``files`` and ``docs``."""

    @classmethod
    def name(cls) -> str:
        return "conll"

    def schema(self) -> str:
        return "file string, doc string, begin int, end int, chain string"

    def reader(self, schema) -> ConllReader:
        only = [set(json.loads(self.options[x])) if x in self.options else None for x in ("files", "docs")]
        return ConllReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), *only)

    def writer(self, schema, overwrite: bool) -> ConllWriter:
        lacking = {"doc", "begin", "end", "chain"} - set(schema.fieldNames())
        if lacking:
            raise ValueError(f"columns to write are missing: {sorted(lacking)}")
        return ConllWriter(self.options["path"], overwrite, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ConllDataSource)


def write_mentions(mentions: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``doc, begin, end, chain``: a document by one task, documents by many."""
    rows = mentions.select(F.col("doc").cast("string"), F.col("begin").cast("int"), F.col("end").cast("int"), F.col("chain").cast("string"))
    rows.repartition("doc").sortWithinPartitions("doc", "begin", "end").write.format("conll").mode(mode).save(path)
