"""Driver query for WARC derivatives."""

from html.entities import html5

from .warc import _BARE, _CHANGED, _DROPPED, BREAKING, HIDDEN, build_derivatives, responses_from_pages


def op1_warc_derivatives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return build_derivatives(responses_from_pages(pages), keep=("page_id",))


def _uuid(expr: str) -> str:
    h = f"sha1({expr})"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-a' || {h}[18:20] || '-' || {h}[21:32] || '>'"


def _list(values) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _unescape(t: str) -> str:
    """Every reference of HTML5, a piece after an ampersand at a time."""
    named = f"map({_list(html5)}, {_list(html5.values())})"
    changed = f"map({_list(_CHANGED)}, {_list(_CHANGED.values())})"

    def numeric(pattern: str, most: int, read: str) -> str:
        digits = f"regexp_extract(x, '{pattern}', 1)"
        code = f"(CASE WHEN length({digits}) > {most} THEN 1114112 WHEN {digits} = '' THEN 0 ELSE {read.format(digits)} END)"
        return (
            f"(CASE WHEN {changed}[{code}::INT] IS NOT NULL THEN chr({changed}[{code}::INT]) WHEN list_contains({_list(_DROPPED)}, {code}::INT) THEN ''"
            f" WHEN {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr({code}::INT) END) || x[length(regexp_extract(x, '{pattern}')) + 1:]"
        )

    whole, bare = "regexp_extract(x, '^[A-Za-z0-9]{1,31};')", "regexp_extract(x, '^(?:" + "|".join(_BARE) + ")')"
    one = (
        f"CASE WHEN regexp_matches(x, '^#[0-9]') THEN {numeric('^#0*([0-9]*);?', 7, '{0}::BIGINT')}"
        f" WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]') THEN {numeric('^#[xX]0*([0-9a-fA-F]*);?', 6, chr(40) + chr(39) + '0x' + chr(39) + ' || {0})::BIGINT')}"
        f" WHEN {named}[{whole}] IS NOT NULL THEN {named}[{whole}] || x[length({whole}) + 1:]"
        f" WHEN {bare} <> '' THEN {named}[{bare}] || x[length({bare}) + 1:] ELSE '&' || x END"
    )
    return f"(string_split({t}, '&')[1] || array_to_string([{one} FOR x IN string_split({t}, '&')[2:]], ''))"


def _text(t: str) -> str:
    out = f"regexp_replace({t}, '<!--[\\s\\S]*?(?:-->|$)', '', 'g')"
    for tag in HIDDEN:
        out = f"regexp_replace({out}, '(?i)<{tag}(?:\\s[^>]*)?>[\\s\\S]*?</{tag}\\s*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{BREAKING})(?:[\\s/][^>]*)?>', chr(10), 'g')"
    return f"regexp_replace({out}, '<[!/?A-Za-z][^>]*>', '', 'g')"


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
a AS (
  SELECT page_id, url, h, {_uuid("'response' || chr(10) || page_id || chr(10) || url")} AS rid, 'sha1:' || sha1(h) AS dig, {_text("h")} AS bare,
    regexp_extract(h, '(?i)<title(?:\\s[^>]*)?>([^<]*)</title\\s*>', 1) AS ti,
    regexp_extract_all(h, '(?i)<a\\s[^>]*?href\\s*=\\s*["\\x27]([^"\\x27>]*)["\\x27]', 1) AS li FROM p),
b AS (
  SELECT *, regexp_replace({_unescape("bare")}, '[ \\t\\r\\f' || chr(160) || ']+', ' ', 'g') AS t1, trim(regexp_replace({_unescape("ti")}, '\\s+', ' ', 'g')) AS t2,
    [li[i] FOR i IN range(1, len(li) + 1) IF list_position(li, li[i]) = i] AS l2 FROM a),
c AS (
  SELECT *, trim(regexp_replace(regexp_replace(t1, ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n|\\n$', '', 'g')) AS txt,
    'title: ' || t2 || chr(13) || chr(10) || 'status: 200' || chr(13) || chr(10) || 'charset: utf-8' || chr(13) || chr(10) || 'source-digest: ' || dig
    || chr(13) || chr(10) || array_to_string(['outlink: ' || x || chr(13) || chr(10) FOR x IN l2], '') AS meta FROM b),
r AS (
  SELECT page_id, rid, url, dig, strlen(h) AS size, chr(13) || chr(10) AS crlf, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, meta AS block FROM c
  UNION ALL SELECT page_id, rid, url, dig, strlen(h), chr(13) || chr(10), 'conversion', 'text/plain; charset=utf-8', txt FROM c)
SELECT page_id, {_uuid("warc_type || chr(10) || rid")} AS record_id, warc_type, rid AS refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS date,
  content_type, dig AS source_digest, 'HTTP/1.1 200 OK' || crlf || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || size || crlf || crlf AS source_headers, strlen(block)::BIGINT AS content_length, 'sha1:' || sha1(block) AS block_digest, block FROM r
"""

QUERIES = {"op1_warc_derivatives": op1_warc_derivatives}
ORACLES = {"op1_warc_derivatives": SQL}
