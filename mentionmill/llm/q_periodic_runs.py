"""Driver query for periodic runs."""

from zlib import crc32

from .periodic_runs import periodic_runs


def fold(doc_id, words):
    """Every tenth document's words repeat from some place on."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    base = words[a : a + p]
    return words[:a] + (base * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold=fold)


#: CRC-32 of a text of ASCII characters, bit by bit (the polynomial is a fixed value).
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) + 0 * z)), 4294967295)"""

#: Equal words by a join, stretches by islands, and the smallest period of each stretch.
RUNS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    {_CRC.format("doc_id::VARCHAR")} AS h FROM documents),
  e AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
  f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
  k AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
  t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
    ELSE ws END AS ws FROM k),
  w AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM t WHERE n > 0),
  m AS (SELECT x.r, x.n, x.i, y.i - x.i AS p FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i WHERE 4 * (y.i - x.i) <= x.n),
  o AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM m),
  s AS (SELECT r, p, min(i) AS s, count(*) + p AS len FROM o GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
  q AS (SELECT r, s, len, min(p) AS p FROM s GROUP BY r, s, len),
  u AS (SELECT r, count(*) AS n_runs, arg_max({{'s': s, 'len': len, 'p': p}}, {{'a': len, 'b': -s, 'c': -p}}) AS best,
    string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM q GROUP BY r),
  z AS (SELECT DISTINCT q.r, unnest(range(q.s + q.p, q.s + q.len)) AS i FROM q),
  c AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS rest FROM w ANTI JOIN z ON w.r = z.r AND w.i = z.i GROUP BY w.r)
SELECT t.doc_id, coalesce(u.n_runs, 0) AS n_runs, u.best.s AS start, u.best.len AS length, u.best.p AS period, 1000 * u.best.len // u.best.p AS exponent_milli,
  sha256(coalesce(u.lines, '')) AS runs_sha256, sha256(coalesce(c.rest, '')) AS collapsed_sha256
FROM t LEFT JOIN u ON t.r = u.r LEFT JOIN c ON t.r = c.r"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": RUNS}
