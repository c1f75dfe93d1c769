"""Secret scans: patterns, and sliding-window entropy with incremental counts.  DataFrame expressions only.

Patterns find three kinds of span (``assign``, ``access``, ``hex``).  The method
adds ``entropy`` spans: candidate strings are runs of 20 or more characters of
``A-Za-z0-9+/_=-`` that hold a letter and a digit.  A candidate's class (hex,
alphanumeric, or with symbols) sets the window and the least entropy; a hex
candidate shorter than its window is one window, with a lower bound.  The
window slides over the candidate; entering and leaving characters change one
count each, and the sum of c*log2(c) is updated from the counts alone, so a
step costs the same however long the window is.  The candidate is a span if
some window reaches the threshold and no allow-list pattern suppresses it, unless a
pattern's span covers it already.

Positions are code points, ends exclusive.  Null text counts as empty.  Rows
are kept as they come, repeated or not.  Inner columns get names that the table
does not have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .columns import quoted, unused

#: The base patterns, in Java's syntax.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Texts that are no secrets (identifiers of known form, placeholders, sequences, repeats).
ALLOW = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|(?i:example|sample|dummy|placeholder|changeme|redacted|lorem)"
    r"|(?i:abcdefgh|qwertyui)|01234567|12345678|[Xx]{5}|={5}|-{5}|_{5}|0{8}"
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: class: (window, least entropy in bits); a uniform 16-symbol window has at most 4, others at most log2(window).
CLASSES = {"hex": (32, 3.25), "alnum": (20, 3.75), "symbol": (20, 3.85)}
#: A hex candidate shorter than its window is one window, and its least entropy is lower by as much as the mean entropy of
#: uniform digits is: that lies about 15 / (2 n ln 2) under 4 bits for n digits.
HEX_BIAS = 15 / (2 * math.log(2))
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "struct<s:int,k:int,e:int>"
_BODY = "struct<s:int,k:int,e:int,b:string>"
PIECE = 512


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(value: str, name: str, kind: str, body: str) -> str:
    """SQL for ``body`` with ``value`` bound to ``name``: a fold over one element."""
    return f"aggregate(array({value}), cast(null as {kind}), (_{name}, {name}) -> {body})"


def _walk(items: str, kind: str, carry: str, when: str, made: str) -> str:
    """SQL for the array of ``made`` of those items for which ``when`` holds, walked with a running number.

    ``at`` is the number before item ``x`` (0 at first), ``carry`` the one after
    it.  An array that is appended to is copied each time, so the items are
    walked in pieces of ``PIECE``, whose first numbers are found beforehand; a long
    array then costs its length times a piece, not its square.
    """
    of = lambda sql, at: sql.replace("{at}", at)
    cut = f"transform(sequence(0, (size(y) - 1) div {PIECE}), i -> slice(y, i * {PIECE} + 1, {PIECE}))"
    firsts = (
        f"aggregate(w, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, c) -> named_struct('at', aggregate(c, a.at, (b, x) -> {of(carry, 'b')}),"
        " 'out', array_append(a.out, a.at)), a -> a.out)"
    )
    piece = (
        f"aggregate(z.`0`, named_struct('at', z.`1`, 'out', cast(array() as array<{kind}>)), (a, x) -> named_struct('at', {of(carry, 'a.at')},"
        f" 'out', if({of(when, 'a.at')}, array_append(a.out, {of(made, 'a.at')}), a.out)), a -> a.out)"
    )
    out = f"array<{kind}>"
    body = _let(cut, "w", out, f"flatten(transform(arrays_zip(transform(w, c -> c), {firsts}), z -> {piece}))")
    return _let(items, "y", out, f"if(size(y) = 0, cast(array() as {out}), {body})")


def _found(text: str, pattern: str, kind: int, group: int = 0, least: int = 0, body: bool = False) -> str:
    """SQL for the array of (s, k, e) of a pattern's matches; ``least``: characters that ``group`` must have; ``body``: and b, the match.

    Matches and the pieces between them have the lengths that give positions.
    """
    p = _quoted(pattern)
    size = f", transform(regexp_extract_all({text}, {p}, {group}), x -> length(x))" if group else ""
    held = f", regexp_extract_all({text}, {p}, 0)" if body else ""
    # fields `0`: characters before the match, `1`: its length, `2`: the group's, or the match
    parts = f"arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), transform(regexp_extract_all({text}, {p}, 0), x -> length(x)){size}{held})"
    span = _BODY if body else _SPAN
    made = f"named_struct('s', {{at}} + x.`0`, 'k', {kind}, 'e', {{at}} + x.`0` + x.`1`" + (", 'b', x.`2`)" if body else ")")
    walked = _walk(parts, span, "{at} + x.`0` + coalesce(x.`1`, 0)", "x.`1` is not null" + (f" and x.`2` >= {least}" if group else ""), made)
    return f"if(rlike({text}, {p}), {walked}, cast(array() as array<{span}>))"


def max_window_entropy(candidate: str, window: int, whole: bool = False) -> str:
    """SQL for the largest Shannon entropy (bits) of a candidate's windows; -1 if it is shorter than one.

    With ``whole`` a shorter candidate is one window.
    """
    least = f"least({window}, size(codes))" if whole else f"{window}"
    n = len(ALPHABET)
    table = ", ".join(["0D"] + [f"{c}D * log2({c}D)" for c in range(1, window + 2)])
    codes = f"transform(filter(split({candidate}, ''), x -> x <> ''), x -> locate(x, '{ALPHABET}'))"
    # entering: count c -> c + 1; leaving: count c -> c - 1
    grow = "(st.s + g[st.c[x.`0` - 1] + 1] - g[st.c[x.`0` - 1]])"
    counts_in = "transform(st.c, (v, i) -> if(i = x.`0` - 1, v + 1, v))"
    step = (
        "aggregate(array(named_struct('s', " + grow + ", 'c', " + counts_in + ")), named_struct('s', 0D, 'c', st.c), (q, r) -> r, r ->"
        " if(x.`1` = 0, r, named_struct('s', r.s + g[r.c[x.`1` - 1] - 1] - g[r.c[x.`1` - 1]], 'c', transform(r.c, (v, i) -> if(i = x.`1` - 1, v - 1, v)))))"
    )
    body = (
        f"aggregate(arrays_zip(transform(codes, v -> v), concat(array_repeat(0, {window}), codes)), "
        f"named_struct('n', 0, 's', 0D, 'c', array_repeat(0, {n}), 'best', -1D), "
        f"(st, x) -> if(x.`0` is null, st, aggregate(array({step}), st, (q, r) -> named_struct('n', q.n + 1, 's', r.s, 'c', r.c, 'best',"
        f" if(q.n + 1 >= {least}, greatest(q.best, log2(cast({least} as double)) - r.s / {least}), q.best)))), st -> st.best)"
    )
    return f"aggregate(array(named_struct('codes', {codes}, 'g', array({table}))), -1D, (z, y) -> {body.replace('codes', 'y.codes').replace('g[', 'y.g[')})"


def _entropy_spans(text: str, taken: str) -> str:
    spans = _found(text, CANDIDATE, 4, body=True)
    kept = f"filter({spans}, c -> rlike(c.b, '[0-9]') and rlike(c.b, '[A-Za-z]') and not rlike(c.b, {_quoted(ALLOW)}))"
    # in order of start, patterns' spans first: the largest end so far tells whether one of them covers a candidate
    both = f"array_sort(concat(transform({taken}, t -> named_struct('s', t.s, 'k', t.k, 'e', t.e, 'b', cast(null as string))), k))"
    free = _walk(both, _BODY, "if(x.k < 4, greatest({at}, x.e), {at})", "x.k = 4 and x.e > {at}", "x")
    hexes, alnum, symbol = ((w, h) for w, h in CLASSES.values())
    high = (
        f"case when rlike(c.b, '^([0-9a-f]+|[0-9A-F]+)$') then {max_window_entropy('c.b', hexes[0], whole=True)} >="
        f" {hexes[1]}D - {HEX_BIAS}D * greatest(0D, 1D / length(c.b) - 1D / {hexes[0]})"
        f" when rlike(c.b, '^[A-Za-z0-9]+$') then {max_window_entropy('c.b', alnum[0])} >= {alnum[1]}"
        f" else {max_window_entropy('c.b', symbol[0])} >= {symbol[1]} end"
    )
    found = f"transform(filter({free}, c -> {high}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))"
    return _let(kept, "k", f"array<{_SPAN}>", f"if(size(k) = 0, cast(array() as array<{_SPAN}>), {found})")


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "_spans_") -> DataFrame:
    """Adds an array of (s, k, e), sorted: code-point start, kind (1-based in ``KINDS``), end."""
    t = f"coalesce({quoted(text_col)}, '')"
    base = unused([*docs.columns, out], "_base_")
    found = docs.withColumn(base, F.expr(f"concat({_found(t, ASSIGN, 1, 2, 8)}, {_found(t, r'AKIA[A-Z0-9]{12,}', 2)}, {_found(t, HEX, 3)})"))
    return found.withColumn(out, F.expr(f"array_sort(concat({base}, {_entropy_spans(t, base)}))")).drop(base)


def span_text(spans: str, most_kind: int = 4) -> Column:
    """``kind:start:end``, comma-joined, of the spans of the first kinds."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(filter({spans}, x -> x.k <= {most_kind}), x -> concat(element_at(array({names}), x.k), ':', x.s, ':', x.e)), ',')"
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each kind, digest of the pattern spans and all spans, for every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = with_spans(base).drop("text")
    count = lambda k: F.expr(f"cast(size(filter(_spans_, x -> x.k = {k})) as long)")
    return held.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), count(4).alias("n_entropy"),
        F.sha2(span_text("_spans_", 3), 256).alias("base_sha256"), span_text("_spans_").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their text replaced by ``mark`` (overlapping spans by one)."""
    names, spans = docs.columns, unused(docs.columns, "_spans_")
    held = with_spans(docs, text_col, spans)
    t = f"coalesce({quoted(text_col)}, '')"
    # (end of the text kept before, start) of each run of overlapping spans; pieces of the text are cut from pieces of it
    runs = _walk(spans, "struct<p:int,s:int>", "greatest({at}, x.e)", "x.s >= {at}", "named_struct('p', {at}, 's', x.s)")
    part = f"array_join(transform(w, x -> concat(substr(g, x.p - w[0].p + 1, x.s - x.p), '{mark}')), '')"
    part = _let(f"substr({t}, w[0].p + 1, w[size(w) - 1].s - w[0].p)", "g", "string", part)
    cut = (
        _let(runs, "m", "string", f"array_join(transform(transform(sequence(0, (size(m) - 1) div {PIECE}), i -> slice(m, i * {PIECE} + 1, {PIECE})), w -> {part}), '')")
    )
    cut = f"concat({cut}, substr({t}, array_max(transform({spans}, x -> x.e)) + 1))"
    new = F.expr(f"if(size({spans}) = 0, {quoted(text_col)}, {cut})")
    return held.select(*[new.alias(c) if c == text_col else F.col(quoted(c)) for c in names])
