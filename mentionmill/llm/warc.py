"""WARC: records, files, and the builder of derivatives.

``build_derivatives`` turns each response record into two new records that refer
to it: ``metadata`` (title, character set, status, out-links, source headers)
and ``conversion`` (plain text).  Both keep the response's id as
WARC-Refers-To, its target, date, HTTP headers and payload digest, and have a
block digest and length of their own.  Record ids are UUIDs made from the
source id and type, so a repeated task gives the same records.

Everything on that path is DataFrame expressions.  Null payloads or headers
count as empty; a null record id or target gives null references.  Rows are
kept as they come; a repeated response gives its derivatives again.

``write_warc`` and ``read_warc`` keep records in ``.warc.gz`` files, one gzip
member a record, with names free for any field.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from html.entities import html5
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import Scratch
from .columns import quoted

#: Characters that a coded field keeps as they are.
_PLAIN = " !\"#$&'()*+,/:;<=>?@[]^`{|}"
#: Elements whose content is no text, and elements that break lines.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
BREAKING = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|article|section|nav|header|footer|main|aside|table|tr|td|th|blockquote|pre|form|figure|hr|option|body|html"
TITLE = r"(?i)<title(?:\s[^>]*)?>([^<]*)</title\s*>"
VERSION = "WARC/1.1"
#: Fixed values of HTML5: names that need no semicolon, numbers that stand for another character, numbers that stand for none.
_BARE = sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))
_CHANGED = {0: 0xFFFD, 0x0D: 0x0D} | {c: ord(bytes([c]).decode("cp1252", "replace")) for c in range(0x80, 0xA0)} | {c: c for c in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_DROPPED = [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))]


def record_id(*parts: Column) -> Column:
    """``<urn:uuid:...>`` from a digest of the parts; null if any is null."""
    h = F.sha1(F.concat_ws("\n", *parts).cast("binary"))
    # version 5, variant 1
    made = F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"),
        F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, made)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text.cast("binary")))


def _named() -> Column:
    """The table by first character and name: Spark looks keys up one after another."""
    by: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by.setdefault(name[0], {})[name] = value
    literal = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    return literal({k: literal(v) for k, v in by.items()})


def unescape(text: Column) -> Column:
    """Character references decoded in one pass, as ``html.unescape`` does.  Give it a plain column: it is read more than once."""
    table = _named()
    value = lambda name: table[F.substring(name, 1, 1)][name]
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    changed = F.create_map(*[F.lit(x) for pair in _CHANGED.items() for x in pair])

    def numeric(digits: Column, base: int, most: int) -> Column:
        # the digits without leading zeros; more than ``most`` are beyond Unicode
        code = F.when(F.length(digits) > most, 0x110000).otherwise(F.coalesce(F.conv(digits, base, 10).cast("long"), F.lit(0)))
        code = F.coalesce(changed[code.cast("int")].cast("long"), F.when(~code.isin(_DROPPED), code), F.lit(-1))
        return F.when(code < 0, "").when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").otherwise(char(code))

    def decoded(x: Column) -> Column:
        """A piece of the text that followed an ampersand."""
        whole = F.regexp_extract(x, "^[A-Za-z0-9]{1,31};", 0)
        bare = F.regexp_extract(x, "^(?:" + "|".join(_BARE) + ")", 0)
        after = lambda n: F.substr(x, F.length(n) + 1)
        ten, hexa = r"^#0*([0-9]*);?", r"^#[xX]0*([0-9a-fA-F]*);?"
        return (
            F.when(x.rlike("^#[0-9]"), F.concat(numeric(F.regexp_extract(x, ten, 1), 10, 7), after(F.regexp_extract(x, ten, 0))))
            .when(x.rlike("^#[xX][0-9a-fA-F]"), F.concat(numeric(F.regexp_extract(x, hexa, 1), 16, 6), after(F.regexp_extract(x, hexa, 0))))
            .when(value(whole).isNotNull(), F.concat(value(whole), after(whole)))
            .when(bare != "", F.concat(value(bare), after(bare)))
            .otherwise(F.concat(F.lit("&"), x))
        )

    parts = F.split(text, "&", -1)
    full = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), full).otherwise(text)


def without_markup(html: Column) -> Column:
    """Hidden elements and tags dropped, a line end at block elements."""
    out = F.regexp_replace(html, r"<!--[\s\S]*?(?:-->|$)", "")
    out = F.regexp_replace(out, rf"(?i)<({'|'.join(HIDDEN)})(?:\s[^>]*)?>[\s\S]*?</\1\s*>", "\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BREAKING})(?:[\s/][^>]*)?>", "\n")
    return F.regexp_replace(out, r"<[!/?A-Za-z][^>]*>", "")


def tidy(text: Column) -> Column:
    """Runs of blanks collapsed, lines trimmed, empty lines dropped.  Give it a plain column: it is read more than once."""
    blanks = "  |[\\t\\r\\f\u00a0]"
    one = F.when(text.rlike(blanks), F.regexp_replace(text, "[ \\t\\r\\f\u00a0]{2,}|[\\t\\r\\f\u00a0]", " ")).otherwise(text)
    return F.array_join(F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def links(html: Column) -> Column:
    """Distinct targets of ``a`` elements, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    return F.array_distinct(found)


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of ``pages(page_id, url, html)``: what a crawler would have kept."""
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")
    )
    return pages.select(
        F.col("page_id"), record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), headers.alias("http_headers"), html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


#: Columns of the records that are made.
MADE = ("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "content_length", "block_digest", "block")


def build_derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response of ``record_id, target_uri, date, http_headers, payload, payload_digest``.

    Returns the ``keep`` columns and ``record_id, warc_type, refers_to,
    target_uri, date, content_type, source_headers, source_digest,
    content_length, block_digest, block``.  A kept column with the name of one of
    these gives way to it; other columns are not read, whatever their names.
    """
    keep = [c for c in keep if c.lower() not in MADE]
    kept = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.lit(None)
    html, headers = F.coalesce(F.col("payload"), F.lit("")), F.coalesce(F.col("http_headers"), F.lit(""))
    base = responses.select(
        kept.alias("_kept"), F.col("record_id").alias("_id"), F.col("target_uri").alias("_uri"), F.col("date").alias("_date"),
        headers.alias("_headers"), F.coalesce(F.col("payload_digest"), digest(html)).alias("_digest"),
        without_markup(html).alias("_bare"), F.regexp_extract(html, TITLE, 1).alias("_named"), links(html).alias("_links"),
    )
    # each step reads plain columns, so no pattern runs twice
    base = base.withColumn("_text", unescape(F.col("_bare"))).withColumn("_title", unescape(F.col("_named"))).drop("_bare", "_named")
    base = base.withColumn("_text", tidy(F.col("_text"))).withColumn("_title", F.trim(F.regexp_replace("_title", r"\s+", " ")))
    status = F.regexp_extract("_headers", r"^HTTP/\S+ ([0-9]{3})", 1)
    charset = F.lower(F.regexp_extract("_headers", r"(?i)charset=([A-Za-z0-9_-]+)", 1))
    fields = F.concat(
        F.lit("title: "), F.col("_title"), F.lit("\r\nstatus: "), status, F.lit("\r\ncharset: "), charset, F.lit("\r\nsource-digest: "), F.col("_digest"),
        F.lit("\r\n"), F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""),
    )
    rows = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_text").alias("block")),
    )
    two = base.select("_kept", "_id", "_uri", "_date", "_headers", "_digest", F.explode(rows).alias("r"))
    block = F.col("r.block")
    return two.select(
        *[F.col(f"_kept.{quoted(c)}") for c in keep], record_id(F.col("r.kind"), F.col("_id")).alias("record_id"), F.col("r.kind").alias("warc_type"), F.col("_id").alias("refers_to"),
        F.col("_uri").alias("target_uri"), F.col("_date").alias("date"), F.col("r.type").alias("content_type"), F.col("_headers").alias("source_headers"),
        F.col("_digest").alias("source_digest"), F.octet_length(block).cast("long").alias("content_length"), digest(block).alias("block_digest"),
        block.alias("block"),
    )


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    """One WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class CutRecord(ValueError):
    """A record whose header or block ends before it should, or that gives no length."""


def parse_records(data: bytes, cut: list | None = None):
    """(fields, block) of each record of uncompressed WARC data; fields by their names in lower case.

    Names of fields are read in any case, with or without a blank after the colon,
    and continuation lines belong to the line before.  A record that is cut, or has
    no length, is not returned: it is added to ``cut`` as (place, reason), or
    raised as ``CutRecord`` where that is None.  After one without a length the
    next record is looked for.
    """
    at = 0

    def report(reason: str):
        if cut is None:
            raise CutRecord(f"record at byte {at}: {reason}")
        cut.append((at, reason))

    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return report("its header is cut")
        head = re.sub("\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace"))
        pairs = (x.partition(":") for x in head.split("\r\n")[1:])
        fields = {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}
        size = fields.get("content-length", "")
        if not size.isdecimal():
            report("it has no length")
            at = end + 4
            continue
        begin = end + 4
        if begin + int(size) > len(data):
            return report("its block is cut")
        yield fields, data[begin : begin + int(size)]
        at = begin + int(size)


#: Column of a record table and its WARC field.  The payload digest of a derivative is that of the payload it refers to.
FIELDS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "content_type": "Content-Type", "source_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "source_headers": "X-Source-HTTP-Headers",
}
#: Fields that may hold line ends; they are percent-encoded.
CODED = ("source_headers",)
FILE_BYTES = 1 << 27


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records (columns as ``FIELDS``, and ``block``) to ``.warc.gz`` files; returns ``file, n_records``.

    A file holds about ``FILE_BYTES`` of blocks at most, beyond a last longer one.
    It is written under a trial name and moved when complete, so repeated tasks
    leave the same files.  Null columns are left out of a record's fields.
    """
    names = list(FIELDS)

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in batch.to_pylist())
        row, k = next(rows, None), 0
        while row is not None:
            name, trial, n, size = f"part-{TaskContext.get().partitionId():06d}-{k:05d}.warc.gz", f"{root}/_trial-{uuid.uuid4().hex}", 0, 0
            with store.open_output_stream(trial) as f:
                while row is not None and size < FILE_BYTES:
                    fields = {FIELDS[c]: quote(row[c], safe=_PLAIN) if c in CODED and row[c] is not None else row[c] for c in names}
                    block = (row["block"] or "").encode()
                    f.write(gzip.compress(record_bytes(fields, block), mtime=0))
                    n, size, row = n + 1, size + len(block), next(rows, None)
            store.move(trial, f"{root}/{name}")
            k += 1
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    made = records.select(*names, "block").mapInArrow(run, "file string, n_records long")
    return Scratch(records.sparkSession, "warc").table(made, "files")


def members(raw: bytes, cut: list):
    """The gzip members of a file, one at a time; a damaged or cut one ends the file and is reported."""
    while raw:
        one = zlib.decompressobj(31)
        try:
            data = one.decompress(raw) + one.flush()
        except zlib.error:
            return cut.append((0, "a gzip member is damaged"))
        if not one.eof:
            cut.append((0, "a gzip member is cut"))
        yield data
        raw = one.unused_data


def read_warc(spark: SparkSession, folder: str, with_cut: bool = False) -> DataFrame:
    """Records of ``.warc`` and ``.warc.gz`` files as columns of ``FIELDS`` and ``block``.

    A task holds one compressed file and one of its members at a time.  Records
    that are cut are left out; with ``with_cut`` each is a row that has only
    ``cut``, the reason.
    """
    names = [*FIELDS, "block", *["cut"] * with_cut]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                raw, rows, cut = data.as_py(), [], []
                for part in members(raw, cut) if raw[:2] == b"\x1f\x8b" else [raw]:
                    for f, b in parse_records(part, cut):
                        own = {c: f.get(w.lower()) for c, w in FIELDS.items()}
                        own |= {c: unquote(own[c]) for c in CODED if own[c] is not None}
                        rows.append([*own.values(), b.decode("utf-8", "replace"), *[None] * with_cut])
                        if len(rows) >= 1000:
                            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
                            rows = []
                if with_cut:
                    rows += [[None] * (len(names) - 1) + [reason] for _, reason in cut]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))
