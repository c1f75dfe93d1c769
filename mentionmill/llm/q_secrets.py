"""Driver query for secret scans."""

from .secrets import ALPHABET, CLASSES, HEX_BIAS, scan


def op6_secret_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
_CAND = r"[A-Za-z0-9+/_=-]{20,}"
_ALLOW = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|(?i:example|sample|dummy|placeholder|changeme|redacted|lorem)"
    r"|(?i:abcdefgh|qwertyui)|01234567|12345678|[Xx]{5}|={5}|-{5}|_{5}|0{8}"
)


def _matches(kind: int, pattern: str, own: str = "0") -> str:
    """Matches with positions, from the lengths of matches and of the pieces between them."""
    return f"""
  SELECT doc_id, {kind} AS k, m[i] AS body, {own} AS own,
         (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p,
           regexp_extract_all(t, '{pattern}', {2 if kind == 1 else 0}) AS g FROM d))"""


def _windows(w: int) -> str:
    """Largest entropy of the windows of ``body``, each counted anew."""
    counts = f"[length(u) - length(replace(u, c, '')) FOR c IN string_split('{ALPHABET}', '')]"
    return f"""list_max([list_sum([CASE WHEN n = 0 THEN 0 ELSE -(n / {w}.0) * log2(n / {w}.0) END FOR n IN {counts}])
      FOR u IN [body[j:j+{w - 1}] FOR j IN range(1, length(body) - {w - 2})]])"""


def _whole() -> str:
    """Entropy of ``body`` as one window."""
    size = "length(body)::DOUBLE"
    return f"list_sum([CASE WHEN n = 0 THEN 0 ELSE -(n / {size}) * log2(n / {size}) END FOR n IN [length(body) - length(replace(body, c, '')) FOR c IN string_split('{ALPHABET}', '')]])"


_H, _A, _S = CLASSES["hex"], CLASSES["alnum"], CLASSES["symbol"]
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, k, s, s + length(body) AS e FROM ({_matches(1, _ASSIGN, "length(g[i])")}) WHERE own >= 8
  UNION ALL SELECT doc_id, k, s, s + length(body) FROM ({_matches(2, "AKIA[A-Z0-9]+")}) WHERE length(body) >= 16
  UNION ALL SELECT doc_id, k, s, s + length(body) FROM ({_matches(3, "[0-9a-f]{32,}")})),
cand AS (
  SELECT c.doc_id, 4 AS k, c.s, c.s + length(body) AS e, CASE
    WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') AND length(body) < {_H[0]} THEN {_whole()} >= {_H[1]} - {HEX_BIAS}::DOUBLE * (1.0 / length(body) - 1.0 / {_H[0]})
    WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') THEN {_windows(_H[0])} >= {_H[1]}
    WHEN regexp_full_match(body, '[A-Za-z0-9]+') THEN {_windows(_A[0])} >= {_A[1]} ELSE {_windows(_S[0])} >= {_S[1]} END AS high
  FROM ({_matches(4, _CAND)}) c
  WHERE regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]') AND NOT regexp_matches(body, '{_ALLOW}')),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT doc_id, k, s, e FROM cand WHERE high AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = cand.doc_id AND b.s <= cand.s AND b.e >= cand.e)),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k] || ':' || s || ':' || e AS x FROM spans)
SELECT d.doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
  count(*) FILTER (k = 4) AS n_entropy, sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 4), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES = {"op6_secret_scan": SQL}
