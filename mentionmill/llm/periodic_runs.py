"""Periodic runs of words: harmonic grid probing.

A run of period p is a stretch of words in which words p apart are the same, as
long as possible, with no smaller period, of at least ``COPIES`` periods and
``LEAST`` words.  Its first words equal those p later over at least three
periods, so whatever its place, three neighbouring multiples of p lie there.
So only these are probed: words at jp and (j+1)p, for every p up to a quarter
of the text, n/4 + n/8 + n/12 + ... places or n log n in all; then, for the few
that are equal, the next two multiples and the places half way between.  What
survives is extended to both sides by comparing arrays of words in chunks that
double.  Periods are taken in rising order and a grid place inside a run found
before, whose period divides p, is skipped: it can only lead to that run again.

Words are whole texts' ``[^\\x20\\x09-\\x0D]+``, compared byte by byte (numbers
given by a dictionary of the text).  Each text is one row's work, of memory in
proportion to the text; texts are never cut.  Null and empty texts have no words
and no runs.  Ties of the longest run go to the smaller start, then period.
Repeated rows and ids are each answered; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import quoted
from .texthash import small_batches

COPIES, LEAST = 4, 6
#: Texts of up to so many words are probed by one table of all their grid places, longer ones period by period.
TABLE = 1 << 14
_GRID: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places jp and periods p with (j+3)p < n, for n up to ``TABLE``: a prefix of a table in order of (j+3)p."""
    size = max(64, 1 << (n - 1).bit_length())
    if size not in _GRID:
        periods = np.arange(1, size // 4 + 1)
        counts = np.maximum(0, (size - 1) // periods - 2)
        p = np.repeat(periods, counts)
        j = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = (j + 3) * p
        order = np.argsort(last, kind="stable")
        _GRID[size] = ((j * p)[order].astype(np.int32), p[order].astype(np.int32), last[order])
    at, p, last = _GRID[size]
    k = np.searchsorted(last, n)
    return at[:k], p[:k]


def _probed(w: np.ndarray, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid places that may lie in a run: equal at two, then at three grid steps and half way between them."""
    hit = np.flatnonzero(w[at] == w[at + p])
    at, p = at[hit], p[hit]
    for halves in (2, 4, 1, 3):
        if not len(at):
            break
        place = at + p * halves // 2
        hit = np.flatnonzero(w[place] == w[place + p])
        at, p = at[hit], p[hit]
    return at, p


def _survivors(w: np.ndarray):
    """(period, rising grid places) by rising period."""
    n = len(w)
    if n <= TABLE:
        at, p = _probed(w, *_grid(n))
        order = np.lexsort((at, p))
        at, p = at[order], p[order]
        cut = np.flatnonzero(np.diff(p)) + 1
        for places, own in zip(np.split(at, cut), np.split(p, cut)):
            if len(own):
                yield int(own[0]), places
        return
    for p in range(1, n // COPIES + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        if len(same) < 3:
            continue
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hit):
            at, own = _probed(w, hit * p, np.full(len(hit), p))
            if len(at):
                yield p, at


def _extend(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words p apart are the same: first and one past the last."""
    n, size, lo, hi = len(w), 32, at, at
    while hi + p < n:  # to the right: first i with w[i] != w[i + p]
        end = min(n - p, hi + size)
        differ = w[hi:end] != w[hi + p : end + p]
        k = int(differ.argmax())
        if differ[k]:
            hi += k
            break
        hi, size = end, size * 2
    size = 32
    while lo > 0:
        begin = max(0, lo - size)
        differ = (w[begin:lo] != w[begin + p : lo + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            lo -= k
            break
        lo, size = begin, size * 2
    return lo, hi + p


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, n)
    if len(numbers) == n:
        return []
    found: dict[tuple[int, int], int] = {}
    by_period: dict[int, list[tuple[int, int]]] = {}
    for p, places in _survivors(w):
        inside = np.zeros(len(places), bool)
        for q in [q for q in by_period if p % q == 0]:
            spans = np.array(by_period[q])  # by start and, as their overlaps are shorter than q, by end too
            k = np.searchsorted(spans[:, 0], places, "right") - 1
            inside |= (k >= 0) & (places + 3 * p < spans[k, 1])
        end, own = -1, []
        for at in places[~inside].tolist():
            if at + 2 * p < end:
                continue
            lo, hi = _extend(w, at, p)
            end = hi - p
            if hi - lo >= max(LEAST, COPIES * p) and (lo, hi) not in found:
                found[lo, hi] = p
                own.append((lo, hi))
        if own:
            by_period[p] = own
    return sorted((lo, hi - lo, p) for (lo, hi), p in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold=None, with_runs: bool = False) -> DataFrame:
    """A row for each row of ``docs``: its runs, the longest one, and the text without repeats.

    ``fold`` (id, words) gives the words to search in place of a text's own.
    With ``with_runs`` the runs (``start, length, period``) and the collapsed
    text come too.
    """
    small_batches(docs.sparkSession)
    longs = ["n_runs", "start", "length", "period", "exponent_milli"]
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    fields = [("doc_id", pa.int64()), *[(n, pa.int64()) for n in longs], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    ddl = "doc_id long, " + ", ".join(f"{n} long" for n in longs) + ", runs_sha256 string, collapsed_sha256 string"
    if with_runs:
        fields += [("runs", run_type), ("collapsed", pa.string())]
        ddl += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    schema = pa.schema(fields)

    def search(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_buffer()  # the UTF-8 bytes
                words = text.to_pybytes().split() if text is not None else []
                if fold is not None:
                    words = fold(doc, words)
                runs = runs_of(words)
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
                rest = b" ".join(collapsed(words, runs))
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                row = [doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(rest).hexdigest()]
                rows.append(row + [[dict(zip(("start", "length", "period"), r)) for r in runs], rest.decode()] if with_runs else row)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [[] for _ in schema], schema=schema)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(search, ddl)
