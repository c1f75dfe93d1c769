"""Text assembly as column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

#: Tokens that take no blank before them, and sentence ends.
NO_BLANK = ("'s", ".", "!", "?", ",", ";", ":", ")", "]", "}")
SENTENCE_ENDS = (".", "!", "?", "''")
#: Texts that begin after an address.
AFTER_ADDRESS = (
    "Lindsay", "Former", "Footage", "Video", ".html", "Gunman",
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
#: Fixed values: (kind, from, to) in the order they apply; kind s: text, r: pattern.
UNTOKENIZE = (
    ("s", "`` ", '"'), ("s", " ''", '"'), ("s", ". . .", "..."), ("s", " ( ", " ("), ("s", " ) ", ") "), ("s", " 's", "'s"),
    ("r", r" ([.,:;?!%]+)([ '`])", "$1$2"), ("r", r" ([.,:;?!%]+)$", "$1"), ("s", " n't", "n't"), ("s", "can not", "cannot"),
    ("s", " ` ", " '"), ("s", " -", "-"), ("s", "- ", "-"), ("s", " ,", ","), ("s", " /", "/"), ("s", "/ ", "/"),
    ("s", " ’ s", "'s"), ("s", "“ ", "“"), ("s", " ”", "”"), ("s", "www. ", "www."), ("s", ". com", ".com"), ("s", " _ ", "_"),
    ("s", "p. m.", "p.m."), ("s", "a. m.", "a.m."), ("s", "P. M.", "P.M."), ("s", "A. M.", "A.M."), ("s", "[EOS]", ""),
    ("r", r'"\s?([^\]]*?)\s?"', '"$1"'), ("s", ',"', ', "'), ("s", '."', '. "'),
)
#: The older rules, likewise.
UNTOKENIZE_OLDER = (
    ("s", "`` ", '"'), ("s", " ''", '"'), ("s", ". . .", "..."), ("s", " ( ", " ("), ("s", " ) ", ") "),
    ("r", r" ([.,:;?!%]+)([ '`])", "$1$2"), ("r", r" ([.,:;?!%]+)$", "$1"), ("s", " '", "'"), ("s", " n't", "n't"), ("s", "can not", "cannot"),
    ("s", " ` ", " '"), ("s", " -", "-"), ("s", "- ", "-"), ("s", " ,", ","), ("s", " /", "/"), ("s", "/ ", "/"),
    ("s", " ’ s", "'s"), ("s", "“ ", "“"), ("s", " ”", "”"), ("s", "www. ", "www."), ("s", ". com", ".com"), ("s", " _ ", "_"),
    ("s", "p. m.", "p.m."), ("s", "a. m.", "a.m."), ("r", r'"\s?([^\]]*?)\s?"', '"$1"'),
)
ADDRESS = r"^(?:http|ftp|https)://[\w_-]+(?:\.[\w_-]+)+[\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def join_tokens(tokens: str | Column) -> Column:
    return F.array_join(_c(tokens), " ")


def span_text(tokens: str | Column, start: str | Column, end: str | Column) -> Column:
    """Text of the tokens from ``start`` to ``end``, both included, counted from 0."""
    return F.array_join(F.slice(_c(tokens), _c(start) + 1, _c(end) - _c(start) + 1), " ")


def raw_document(sentences: DataFrame, by: list[str], order: str, boundary: str | None = None) -> DataFrame:
    """Sentences of a document in one text, with a boundary mark between them where asked."""
    sep = f" {boundary} " if boundary else " "
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.array_join("tokens", " ").alias("text"))))
    return sentences.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["text"]), sep).alias("text"))


def sentence_context(tokens: str | Column, marks: str | Column | None = None) -> Column:
    """One sentence as text: no blank before closing punctuation, a full stop where no end mark is.

    ``marks``: array of structs (start, end), places from 0; each is wrapped in ``<mention>``.
    """
    t = _c(tokens)

    def piece(x: Column, i: Column) -> Column:
        word = F.concat(F.when(x.isin(*NO_BLANK), "").otherwise(" "), x)
        if marks is None:
            return word
        opens = F.exists(_c(marks), lambda m: m["start"] == i)
        closes = F.exists(_c(marks), lambda m: m["end"] == i)
        return F.concat(F.when(opens, " <mention>").otherwise(""), word, F.when(closes, " </mention>").otherwise(""))

    text = F.array_join(F.transform(t, piece), "")
    return F.when(F.element_at(t, -1).isin(*SENTENCE_ENDS), text).otherwise(F.concat(text, F.lit(".")))


def tidy_context(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("`` "), F.lit('"')), F.lit(" ''"), F.lit('"'))


def pair_contexts(pairs: DataFrame, sentences: DataFrame, level: str, mark: bool = False, selected_only: bool = False, splitter: str = " ") -> DataFrame:
    """``context`` of each pair.

    ``pairs``: pair_id, and for each end doc, sent, start, end with prefixes m1_
    and m2_.  ``sentences``: doc, sent, tokens (and selected).  Levels: ``sent``
    (the mentions' sentences), ``middle`` (and those between them), ``doc``
    (from the beginning to the later mention).  Across documents each side has
    its own part, the first mention's first.
    """
    same_doc = F.col("m1_doc") == F.col("m2_doc")
    lo, hi = F.least("m1_sent", "m2_sent"), F.greatest("m1_sent", "m2_sent")
    frame = lambda part, doc, first, last: F.struct(F.lit(part).alias("part"), F.col(doc).alias("doc"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    s1, s2, zero = F.col("m1_sent"), F.col("m2_sent"), F.lit(0)
    own = F.array(frame(0, "m1_doc", s1, s1), frame(1, "m2_doc", s2, s2))
    one = F.array(frame(0, "m1_doc", s1, s1))
    if level == "sent":
        frames = F.when(same_doc & (s1 == s2), one).otherwise(own)
    elif level == "middle":
        frames = F.when(same_doc, F.array(frame(0, "m1_doc", lo, hi))).otherwise(own)
    elif level == "doc":
        frames = F.when(same_doc, F.array(frame(0, "m1_doc", zero, hi))).otherwise(F.array(frame(0, "m1_doc", zero, s1), frame(1, "m2_doc", zero, s2)))
    else:
        raise ValueError(f"unknown level {level!r}")
    ends = [F.struct(F.col(f"{m}_doc").alias("doc"), F.col(f"{m}_sent").cast("long").alias("sent"), F.col(f"{m}_start").alias("start"), F.col(f"{m}_end").alias("end")) for m in ("m1", "m2")]
    flat = pairs.select("pair_id", F.array(*ends).alias("ends"), F.explode(frames).alias("f"))
    s = sentences.where("selected") if selected_only else sentences
    s = s.select(F.col("doc"), F.col("sent").cast("long").alias("sent"), "tokens")
    rows = flat.join(s, (F.col("f.doc") == s.doc) & F.col("sent").between(F.col("f.first"), F.col("f.last")))
    here = F.filter("ends", lambda e: (e["doc"] == F.col("doc")) & (e["sent"] == F.col("sent")))
    text = sentence_context("tokens", here if mark else None)
    parts = rows.select("pair_id", "f.part", "sent", text.alias("text")).groupBy("pair_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "text"))), lambda x: x["text"]), "").alias("text")
    )
    whole = parts.groupBy("pair_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), splitter).alias("text")
    )
    return whole.select("pair_id", tidy_context(F.col("text")).alias("context"))


def fill_template(template: str | Column, values: dict[str, Column | str]) -> Column:
    """Placeholders ``[NAME]`` replaced, contexts before mentions."""
    out = _c(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"[{name}]"), F.coalesce(_c(value), F.lit("")))
    return out


def few_shot_prompt(examples: DataFrame, by: list[str], order: str, text: str = "prompt", answer: str = "answer") -> DataFrame:
    """Worked examples of each group in one prefix."""
    shot = F.struct(F.col(order), F.concat_ws(" ", F.col(text), F.col(answer)).alias("t"))
    return examples.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(shot)), lambda x: x["t"]), "\n").alias("prefix"))


def chat_messages(prefix: str | Column, question: str = "Q:", answer: str = "A:") -> Column:
    """Array of (role, content) of a prefix whose lines begin with question and answer marks."""
    lines = F.filter(F.split(_c(prefix), "\n"), lambda x: x.startswith(question) | x.startswith(answer))
    role = lambda x: F.when(x.startswith(question), "user").otherwise("assistant")
    text = lambda x: F.trim(F.regexp_replace(x, f"^(?:{question}|{answer})", ""))
    return F.transform(lines, lambda x: F.struct(role(x).alias("role"), text(x).alias("content")))


def untokenize(text: str | Column, keep_address: bool = True, rules: tuple = UNTOKENIZE) -> Column:
    """Blanks and punctuation put back where people expect them; a leading address is split from the text, or dropped."""
    out = _c(text)
    for kind, a, b in rules:
        out = F.replace(out, F.lit(a), F.lit(b)) if kind == "s" else F.regexp_replace(out, a, b)
    return split_address(out, keep_address)


def split_address(text: str | Column, keep: bool = True) -> Column:
    """A long leading address that runs into a known first word is cut before that word."""
    t = _c(text)
    address = F.regexp_extract(t, ADDRESS, 0)
    rest = F.substr(t, F.length(address) + 1)
    words = "|".join(w.replace(".", r"\.") for w in AFTER_ADDRESS)
    head = F.regexp_extract(address, rf"^(.*?)({words})", 1)
    word = F.regexp_extract(address, rf"^(.*?)({words})", 2)
    cut = (F.length(address) > 10) & (word != "")
    split = F.concat(head, F.lit(" "), word) if keep else word
    return F.when(address == "", t).otherwise(F.concat(F.when(cut, split).otherwise(address if keep else F.lit("")), rest))


def clean_sentences(text: str | Column) -> Column:
    """Each ``[EOS]``-separated sentence untokenized, joined by the mark again."""
    return F.array_join(F.transform(F.split(_c(text), r"\[EOS\]"), lambda s: untokenize(s)), "[EOS]")


def tagged_text(tokens: DataFrame, by: list[str], order: str) -> DataFrame:
    """Tokens of a document with runs of one cluster wrapped as ``{tag_id:n words }`` (``token, tag``; tag null outside)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag("tag").over(w), F.lead("tag").over(w)
    opens = F.col("tag").isNotNull() & ~F.col("tag").eqNullSafe(before)
    closes = F.col("tag").isNotNull() & ~F.col("tag").eqNullSafe(after)
    piece = F.concat(F.when(opens, F.concat(F.lit("{tag_id:"), F.col("tag").cast("string"), F.lit(" "))).otherwise(""), "token", F.when(closes, " }").otherwise(""))
    marked = tokens.withColumn("_p", piece)
    return marked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_p"))), lambda x: x["_p"]), " ").alias("text"))


def plain_with_punctuation(tokens: str | Column) -> Column:
    """Token text with blanks only where the next token is no punctuation."""
    return F.ltrim(F.array_join(F.transform(_c(tokens), lambda x: F.concat(F.when(x.rlike(r"^[.,:;?!%)\]}']"), "").otherwise(" "), x)), ""))


def parse_pair_dicts(text: str | Column) -> Column:
    """Two mention dicts with single quotes on lines of their own, as an array of structs."""
    listed = F.concat(F.lit("["), F.regexp_replace(F.trim(_c(text)), r"\}\s*\n\s*\{", "},{"), F.lit("]"))
    schema = "array<struct<tokens:string,tokens_ids:array<int>,m_id:string,cluster_id:bigint>>"
    return F.from_json(listed, schema, {"allowSingleQuotes": "true"})


def string_keys(held: str | Column) -> Column:
    """A map with its keys as text, as JSON needs them."""
    return F.transform_keys(_c(held), lambda k, _: k.cast("string"))


def parse_counts(text: str | Column) -> Column:
    """``[1, 2, 3]`` as an array of integers."""
    return F.from_json(_c(text), "array<int>")


def split_two(text: str | Column, sep: str = ";") -> tuple[Column, Column]:
    parts = F.split(_c(text), sep, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def sentence_of(place: str | Column, dividers: str | Column) -> Column:
    """Sentence number of a token from the cumulative dividers of its document."""
    return F.size(F.filter(_c(dividers), lambda d: d <= _c(place)))


@F.pandas_udf(IntegerType())
def _fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if x is None or y is None else int(round(100 * difflib.SequenceMatcher(None, x, y).ratio())) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int32")


def fuzzy_ratio(a: str | Column, b: str | Column) -> Column:
    """Similarity of two texts by matching blocks, 0 to 100."""
    return _fuzzy(_c(a), _c(b))


def pronoun_override(tag: str | Column, mention: str | Column, pronouns: list[str]) -> Column:
    """``PRON`` for mentions on a list of pronouns, the given tag otherwise."""
    return F.when(F.lower(_c(mention)).isin(*pronouns), "PRON").otherwise(_c(tag))
