"""Operators give whole results: every reference, every column, every secret."""

import hashlib
import html as html_lib
import zlib
from html.entities import html5

import numpy as np
from compare import DATA
from pyspark.sql import functions as F

from mentionmill.llm import q_sentencepiece, q_warc, secrets, warc

SF = f"{DATA}/sf0.001"


def test_every_reference(spark):
    texts = [f"a &{n} b" for n in html5] + [f"a &{n}b" for n in html5]
    texts += [f"&#{c};" for c in [*range(0, 300), 0x2019, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9, 10**30]]
    texts += ["&#x80;&#X2019 &#x0000041;", "&#038;lt; &amp;lt; &amp;amp;amp; &ampx &notit; &notin; &no; &; &# &#; &#x; &#xg &&&lt", "&#65&#66 &#150 x", "&middot;&rsquo;&uuml;&euro;&NotEqualTilde;", "no", "", "&", "a&b", "&middot"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.u for r in df.select("i", warc.unescape(F.col("t")).alias("u")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != html_lib.unescape(t)] == []


def test_pages_hold_no_reference(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.build_derivatives(warc.responses_from_pages(pages)).where("warc_type = 'conversion'")
    assert got.where(F.col("block").rlike("&[a-z]+;")).count() == 0 and got.count() > 0


def test_op1_returns_the_blocks(spark):
    for r in q_warc.op1_warc_derivatives(spark, SF).collect():
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha1:" + hashlib.sha1(r.block.encode()).hexdigest()


def test_op8_returns_the_ids(spark):
    got = q_sentencepiece.op8_sentencepiece(spark, SF).collect()
    assert got and all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_short_hex_secrets(spark):
    texts = ["key 9f86d081884c7d659a2f end", "KEY 9F86D081884C7D659A2FEAA0C5 end", "9f86d081884c7d659a2feaa0c55ad01", "1111111111aaaaaaaaaa", "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = ["entropy:4:24", "entropy:4:30", "entropy:0:31", "", "entropy:0:40"]
    assert [r.spans for r in secrets.scan(df).orderBy("doc_id").collect()] == want
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()][:2] == ["key [SECRET] end", "KEY [SECRET] end"]


def test_short_hex_secrets_by_sql(spark, tmp_path):
    """The SQL of the query on secrets of every class and length, random and not."""
    import random

    from compare import connect, rows
    from mentionmill.llm import q_secrets

    rnd = random.Random(7)
    make = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = [make(a, n) for a in ("0123456789abcdef", "0123456789ABCDEF", "0123ab", "abcXYZ019+/_") for n in range(18, 45)]
    texts += [f"x {a} token={b} {c}" for a, b, c in zip(texts, texts[1:], texts[2:])] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = q_secrets.op6_secret_scan(spark, str(tmp_path))
    r = connect(str(tmp_path)).execute(q_secrets.SQL)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


def test_many_secrets_in_one_text(spark):
    """More matches than a piece holds, of every kind, overlapping and not: positions and redaction by plain Python."""
    import random
    import re

    rnd = random.Random(3)
    make = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = [rnd.choice([f"token={make(word, 10)}", f"é{make('0123456789abcdef', 40)}", "AKIA" + make("ABC0", 16), make(word, 24), "plain", f"secret: {make('0123456789abcdef', 34)}"]) for _ in range(2500)]
    text = " ".join(bits)
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 3])], "doc_id long, text string")
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(","))] for r in secrets.scan(df).collect()}
    redacted = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    for d, t in ((1, text), (2, text[: len(text) // 3])):
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{32,}", t)]
        assert sorted(s for s in spans[d] if s[0] != "entropy") == sorted(base) and len(base) > 500
        extra = [s for s in spans[d] if s[0] == "entropy"]
        assert extra and all(re.fullmatch("[A-Za-z0-9+/_=-]{20,}", t[a:b]) and not any(x <= a and y >= b for _, x, y in base) for _, a, b in extra)
        at, out = 0, ""
        for _, a, b in sorted(spans[d], key=lambda s: s[1]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert redacted[d] == out + t[at:]


def test_very_long_texts(spark):
    """Six million characters, and a word of 200,000, through every operator on texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from mentionmill.llm import jaccard_join, language_id, packing, sentencepiece_backend, token_files, toxicity
    from mentionmill.storage import new_path

    path = public_tokenizers.path("word_bpe_49k.json")
    words = [f"word{i % 9973}" for i in range(600_000)]
    texts = [" ".join(words), " ".join(words[:-3] + ["token=abcdefgh12", "you", "idiot"]), "ab " + "y" * 200_000 + " z", "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    tok = Tokenizer.from_file(path)
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    folder = new_path(spark, "long")
    assert {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, path, 2)).collect()} == want
    packed = packing.pack(packing.piece_rows(docs, path, 1, 4096), 4096).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == want
    assert all(r.parity and r.round_trip for r in sentencepiece_backend.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert {r.doc_id: r.n_assign for r in secrets.scan(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    model = language_id.learn(spark.createDataFrame([(1, "word the", "en"), (2, "le mot", "fr")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}[0] == "en"
    rows = [(i, "you idiot" if i % 2 else "fine day", i % 2) for i in range(60)]
    trained = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("toxic"), spark.createDataFrame(rows, "doc_id long, text string, toxic int").drop("text"))
    assert len(toxicity.score(docs, trained).collect()) == 4
