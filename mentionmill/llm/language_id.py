"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered and every run of other characters between two letters becomes
one blank.  All 2-, 3- and 4-grams of the result, with a blank before it and
blanks after it, are hashed into ``BUCKETS``.  Counts per language come from a
bounded sample of labelled texts (at most about ``SAMPLE`` rows, chosen by a hash
of the id), are summed in Spark, and become a matrix of log probabilities that
is broadcast: 256 KB for each language of the sample.  A batch is scored by
gathering matrix rows for its n-grams and summing them per text.

Log probabilities are whole numbers of 2**-20, so a text's sum depends neither on
the order of the terms nor on the rows beside it.  Texts are taken in parts of at
most ``PART`` characters that end after a character other than a letter (or at
``PART``, within a longer word), so memory does not grow with a text's length.

The score tells the known languages apart and comes to 1 for any longer text, in
whatever language.  ``fit`` tells whether a text is in its best language at all:
the mean log probability of its n-grams there, on a scale where that of the
training texts is 1 and that of n-grams drawn evenly from the buckets is 0.

Null texts and texts without a letter are ``und`` with score 0, as is everything
if nothing could be learned.  Ties go to the language that sorts first.  Rows
are kept as they come; a repeated row is predicted again.  Columns of ``docs``
that have the names of new ones do no harm: see ``beside``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import quoted, unused
from .texthash import blocks, mix, small_batches

BUCKETS, SAMPLE, ORDERS, ALPHA = 1 << 16, 16_384, (2, 3, 4), 0.5
PART, HELD, AT_ONCE = 1 << 16, 1 << 20, 16  # characters; counts of a task; languages scored at once
_ONE = 1 << 20
UNKNOWN = "und"
_U = np.uint64
_LETTER: dict[str, np.ndarray] = {}
_MULT = tuple(_U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if "t" not in _LETTER:
        _LETTER["t"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER["t"]


def parts_of(text: str | None) -> list[str]:
    """The text in parts of at most ``PART`` characters, cut after characters other than letters."""
    text, out, at = text or "", [], 0
    while len(text) - at > PART:
        own = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(~_letters()[own])
        size = int(ends[-1]) + 1 if len(ends) else PART
        out.append(text[at : at + size])
        at += size
    return [*out, text[at:]]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the n-grams of every position, n+1 offsets of each text's positions, letters in each text)."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    wide = max(ORDERS) - 1
    blank = np.full(wide, 32, np.uint32)
    flat = np.concatenate([blank, *(p for c in codes for p in (c, blank))])
    size = np.array([len(c) for c in codes], np.int64)
    begin = np.cumsum(size + wide) - size  # each text's first character
    between = np.ones(len(flat), bool)
    between[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
    letter = _letters()[flat] & ~between
    gap = ~letter & ~between
    gap[1:] &= letter[:-1]
    keep = letter | between | gap
    left = np.flatnonzero(keep)
    keep[left[:-1][gap[left[:-1]] & between[left[1:]]]] = False  # a gap after the last letter
    ends = np.concatenate([[0], np.cumsum(keep)])
    first, last = ends[begin] - 1, ends[begin + size]  # from the blank before a text
    letters = np.concatenate([[0], np.cumsum(letter)])
    letters = letters[begin + size] - letters[begin]
    size = np.where(letters > 0, last - first, 0)
    at = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(first - at[:-1], size) + np.arange(at[-1])
    kept = np.where(letter, flat, 32)[keep].astype(_U)
    n = len(kept)
    hashed = []
    for order in ORDERS:
        h = np.full(n, order * 0x2545F4914F6CDD1D & (1 << 64) - 1, _U)
        for j in range(order):
            h[: n - j] += kept[j:] * _MULT[j]
        hashed.append((mix(h) >> _U(48)).astype(np.int64) & (BUCKETS - 1))
    return np.stack(hashed, 1)[own], at, letters


def sample_rows(df: DataFrame, id_col: str, most: int, n: int | None = None) -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of the id; all rows if there are no more.

    ``n``: a known count of the rows, or of a few more.
    """
    n = df.count() if n is None else n
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


class NaiveBayes:
    """Languages and their log probabilities (buckets x languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        p = counts + ALPHA
        logp = np.log(p) - np.log(p.sum(0))
        self.logp = np.round(logp * _ONE).astype(np.int32)
        self.prior = np.log(docs + 1.0) - np.log((docs + 1.0).sum()) if len(docs) else docs
        # mean log probabilities of even n-grams and of the training texts' n-grams
        self.chance = logp.mean(0)
        self.typical = (counts * logp).sum(0) / np.maximum(counts.sum(0), 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and fit of each text."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        total, size, letters = np.zeros((n, len(self.langs)), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for own, parts in runs_of_parts(texts):
            buckets, at, some = grams(parts)
            np.add.at(size, own, np.diff(at))
            np.add.at(letters, own, some)
            for lo in range(0, len(self.langs), AT_ONCE):
                sums = np.zeros((len(buckets) + 1, min(AT_ONCE, len(self.langs) - lo)), np.int64)
                for j in range(buckets.shape[1]):
                    sums[1:] += self.logp[buckets[:, j], lo : lo + AT_ONCE]
                np.cumsum(sums, 0, out=sums)
                np.add.at(total[:, lo : lo + AT_ONCE], own, sums[at[1:]] - sums[at[:-1]])
        total = total / _ONE
        mean = total / np.maximum(size * len(ORDERS), 1)[:, None]
        total += self.prior
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        seen = letters > 0
        fit = (mean[np.arange(n), best] - self.chance[best]) / np.maximum(self.typical - self.chance, 1e-9)[best]
        langs = [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen)]
        return langs, np.where(seen, np.minimum(score, 1.0), 0.0), np.where(seen, fit, 0.0)


def runs_of_parts(texts: list[str | None]):
    """(number of its text for each part, parts) of runs of about four times ``PART`` characters."""
    own, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in parts_of(t):
            own.append(i)
            parts.append(part)
            size += len(part) + 1
            if size >= 4 * PART:
                yield np.array(own), parts
                own, parts, size = [], [], 0
    if parts:
        yield np.array(own), parts


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> NaiveBayes:
    """Fit on at most about ``most`` rows; only sums per language and bucket reach the driver."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull())
    n = rows.select(id_col).count()  # counted without the texts
    rows = rows.where(F.col(text_col).isNotNull())
    rows = sample_rows(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")), "id", most, n)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        docs: dict[str, int] = {}
        held, size = [], 0

        def merged():
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        def out(keys, counts):
            names = pa.array(list(docs), pa.string()).take(pa.array(keys >> 16))
            return pa.record_batch([names, pa.array((keys & BUCKETS - 1).astype(np.int32)), pa.array(counts)], schema=schema)

        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lang in langs:
                docs[lang] = docs.get(lang, 0) + 1
            number = {lang: i for i, lang in enumerate(docs)}
            of = np.array([number[x] for x in langs], np.int64)
            for own, parts in runs_of_parts(texts):
                buckets, at, _ = grams(parts)
                keys = (np.repeat(of[own], np.diff(at))[:, None] << 16) + buckets
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged())
        if docs:
            yield pa.record_batch([pa.array(list(docs), pa.string()), pa.array([-1] * len(docs), pa.int32()), pa.array(list(docs.values()), pa.int64())], schema=schema)

    sums = rows.select("t", "l").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most BUCKETS + 1 rows for each language of the sample
    n_docs = got[got.bucket < 0].set_index("lang").n
    langs = sorted(n_docs.index)
    grams_ = got[got.bucket >= 0]
    counts = np.zeros((BUCKETS, len(langs)))
    counts[grams_.bucket.to_numpy(), np.searchsorted(np.array(langs, object), grams_.lang.to_numpy(object))] = grams_.n.to_numpy()
    return NaiveBayes(langs, counts, n_docs.reindex(langs).to_numpy(float))


def identify(
    docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_fit: bool = False, into: str | None = None
) -> DataFrame:
    """``lang_pred, score`` (and ``fit``) beside the id, or beside the columns named in ``keep``; with ``into``, in a struct of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers of 4 bytes

    def predict(texts):
        langs, scores, fits = [], [], []
        for _, part in blocks(texts, texts):
            a, b, c = shared.value.judge(part)
            langs += a
            scores.append(b)
            fits.append(c)
        numbers = [pa.array(np.concatenate(x) if x else [], pa.float64()) for x in ((scores, fits) if with_fit else (scores,))]
        return [pa.array(langs, pa.string()), *numbers]

    return beside(docs, keep or [id_col], text_col, predict, "lang_pred string, score double" + ", fit double" * with_fit, into)


def beside(docs: DataFrame, keep: list[str], text_col: str, predict, added: str, into: str | None = None) -> DataFrame:
    """The ``keep`` columns of every row and the ``added`` ones, which ``predict`` makes from a list of texts.

    Only the text goes to Python, and only the new columns come back.  A kept
    column with the name of an added one gives way to it; with ``into`` the added
    ones are fields of one column of that name and all kept ones stay.
    """
    import pandas as pd

    small_batches(docs.sparkSession)
    names = [x.split(" ")[0] for x in added.split(", ")]

    def run(batches):
        for texts in batches:
            yield pd.DataFrame({n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, predict(texts.tolist()))})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judge = F.pandas_udf(run, "struct<" + ", ".join(x.replace(" ", ":", 1) for x in added.split(", ")) + ">")
    found = into or unused(keep, "_found_")
    out = docs.select(*[F.col(quoted(c)) for c in keep], judge(F.col(quoted(text_col))).alias(found))
    if into:
        return out
    stay = [c for c in keep if c.lower() not in names]
    return out.select(*[F.col(quoted(c)) for c in stay], *[F.col(f"{quoted(found)}.{n}").alias(n) for n in names])
