"""Token files, packing and the SentencePiece backend: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mentionmill.llm import packing, sentencepiece_backend, simple8b, token_files, tokenmemo
from mentionmill.storage import new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a<|endoftext|>b", ".", ",.", "é.", "a.b, c", "it's, dogs', ...", " x. y,", "İstanbul. Ḱ", "x" * 50, "\x1ca.\x0bb", "×. ÷, ß. ñ,", "日本語. テスト,",
    "3, 4.5. 6'", "#&, a", "Å. İ,", "á é.", "A\n\nB\tc", "&&&. ***, ok",
]


def plain_ids(texts):
    tok = Tokenizer.from_file(WORDS)
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_memo_equals_the_library(texts):
    ids, off = tokenmemo.word_memo(WORDS).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == plain_ids(texts)


def test_memo_on_odd_and_long_texts(monkeypatch):
    memo = tokenmemo.WordMemo(WORDS)
    texts = ODD + [" ".join(f"word{i} thing, {i}." for i in range(300))]
    want = [i + [2] for i in plain_ids(texts)]
    for limit in (1 << 22, 50):
        monkeypatch.setattr(tokenmemo, "LONG", limit)
        ids, off = memo.encode(texts, 2)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    monkeypatch.setattr(tokenmemo, "MEMO_WORDS", 3)
    ids, off = memo.encode(texts, 2)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def thue_morse(n):
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return [a, a.translate({97: "b", 98: "a"})]


def test_periodic_words_have_their_own_ids(spark):
    """Words that a polynomial modulo 2**64 cannot tell apart, together and through the queries' operators."""
    texts = [w for n in (8, 64, 256, 264, 1024, 4096) for w in thue_morse(n)]
    ids, off = tokenmemo.WordMemo(WORDS).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == plain_ids(texts)
    memo = sentencepiece_backend.PieceMemo(PIECES, 1)
    ids, off = memo.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [memo.own.encode(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: zlib.crc32(np.array(x + [2], "<u4").tobytes()) for i, x in enumerate(plain_ids(texts))}
    folder = new_path(spark, "t")
    manifest = token_files.write_token_files(docs, folder, WORDS, 2)
    assert {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(spark, folder, manifest).collect()} == want
    check_packing(packing.pack(packing.piece_rows(docs, WORDS, 1, 256), 256).collect(), list(enumerate(texts)), 256)
    assert all(r.parity and r.round_trip for r in sentencepiece_backend.encode_pieces(docs, PIECES).collect())


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """With next to no hash at all, every word still has its own ids."""
    monkeypatch.setattr(tokenmemo, "span_hashes", lambda lanes, s, e: ((e - s) % 3).astype(np.uint64))
    texts = ODD + thue_morse(300) + ["x" * 400 + c for c in "abc"] + [" ".join(f"word{i} thing{i % 7}, {i}." for i in range(60))]
    memo, pieces = tokenmemo.WordMemo(WORDS), sentencepiece_backend.PieceMemo(PIECES, 1)
    for _ in range(2):
        ids, off = memo.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == plain_ids(texts)
        ids, off = pieces.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [pieces.own.encode(t or "") for t in texts]
    assert memo.table.other and pieces.table.other


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.pack(v)
    assert np.array_equal(simple8b.unpack(words, offsets, len(v)), v)
    # every block can be decoded by itself
    for b in range(len(offsets) - 1):
        part = v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        own = words[offsets[b] : offsets[b + 1]]
        assert np.array_equal(simple8b.unpack(own, np.array([0, len(own)]), len(part)), part)


def test_simple8b_density_and_bad_files():
    assert len(simple8b.pack(np.zeros(512, np.uint64))[0]) == 9
    assert len(simple8b.pack(np.full(512, 30_000, np.uint64))[0]) == 128
    image = simple8b.to_bytes(np.array([5]), np.array([3]), np.array([1, 2, 3]))
    ids, ends, values = simple8b.from_bytes(image)
    assert (ids.tolist(), ends.tolist(), values.tolist()) == ([5], [3], [1, 2, 3])
    with pytest.raises(ValueError):
        simple8b.from_bytes(b"XXXX" + image[4:])
    with pytest.raises(ValueError):
        simple8b.from_bytes(image[:-8])


def test_token_files(spark, awkward, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 2000)
    folder = new_path(spark, "t")
    manifest = token_files.write_token_files(awkward, folder, WORDS, 2)
    got = token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()
    docs = sorted(((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (d, _), ids in zip(got, docs, plain_ids([t for _, t in docs]), strict=True):
        ids = ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(r.n_tokens for r in manifest.collect()) == start


def test_token_files_keep_every_id(spark):
    ids = [None, None, -(2**63), -1, 0, 2**63 - 1]
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    folder = new_path(spark, "t")
    got = token_files.read_token_files(spark, folder, token_files.write_token_files(docs, folder, WORDS, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids


def test_starts_over_groups_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    made = [(part, k, f"f{part}-{k}", 1, 1 + (part * 5 + k * 3) % 7) for part in range(11) if part != 4 for k in range(1 + part % 3)]
    got = {r.file: r.start for r in token_files._with_starts(spark.createDataFrame(made[::-1], "part long, k long, file string, n_docs long, n_tokens long")).collect()}
    start = 0
    for _, _, name, _, n in made:
        assert got[name] == start
        start += n


def test_repeated_and_empty_rows_are_packed(spark):
    docs = [(1, "same text")] * 700 + [(i, "") for i in range(900)]
    rows = packing.piece_rows(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, 1, 64)
    n, total = check_packing(packing.pack(rows, 64).collect(), docs, 64)
    assert n <= -(-total // 64) + 1


def test_token_files_of_nothing(spark, no_docs):
    folder = new_path(spark, "t")
    manifest = token_files.write_token_files(no_docs, folder, WORDS, 2)
    assert token_files.read_token_files(spark, folder, manifest).count() == 0


def check_packing(got, docs, capacity):
    want = {}
    for d, ids in zip((d for d, _ in docs), plain_ids([t for _, t in docs])):
        ids = ids + [1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.setdefault((d, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    have = {}
    seqs = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: len(v) for k, v in have.items()} == {k: len(v) for k, v in want.items()}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(r.length for r in got)


def test_packing_awkward(spark, awkward, no_docs):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = packing.pack(packing.piece_rows(awkward, WORDS, 1, 256), 256).collect()
    n, total = check_packing(got, docs, 256)
    assert n <= -(-total // 256) + 1
    assert packing.pack(packing.piece_rows(no_docs, WORDS, 1, 256), 256).count() == 0


def test_packing_over_rounds(spark, monkeypatch):
    """Many partitions and carried bins: everything stays, and few sequences are used."""
    docs = [(i, "a " * (1 + i * 37 % 90)) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.piece_rows(df, WORDS, 1, 128)
    for carry in (20_000, 3):
        monkeypatch.setattr(packing, "CARRY", carry)
        monkeypatch.setattr(packing, "FAN", 4)
        monkeypatch.setattr(packing, "PART_ROWS", 100)
        n, total = check_packing(packing.pack(rows, 128).collect(), docs, 128)
        assert n <= total / 128 * (1.02 if carry > 3 else 1.2)


def test_best_fit():
    bins = packing.best_fit(np.array([5, 5, 3, 7, 2, 8]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 1], [2, 3], [4, 5]]
    assert packing.best_fit(np.array([], int), 10) == []


def test_sentencepiece_parity(spark, awkward):
    got = sentencepiece_backend.encode_pieces(awkward, PIECES, with_ids=True).collect()
    assert len(got) == awkward.count() and all(r.parity and r.round_trip for r in got)
    back = sentencepiece_backend.decode_pieces(spark.createDataFrame([(r.doc_id, r.ids) for r in got if r.doc_id == 12], "doc_id long, ids array<long>"), PIECES)
    assert back.first().text == "été über señor 日本語 ²"


def test_sentencepiece_odd_and_long(monkeypatch):
    memo = sentencepiece_backend.PieceMemo(PIECES, 1)
    texts = ["", " ", "a", "  a", "a\nb", " a", "a ", "a  b\n\nc", "\n", "\ta\tb", "é　x", "▁▁a b▁", "a \nb", "a\n b", "<s> </s> <unk>", "word " * 90]
    for limit in (1 << 22, 60):
        monkeypatch.setattr(sentencepiece_backend, "LONG", limit)
        ids, off = memo.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [memo.own.encode(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\x00"), max_size=30), min_size=1, max_size=5))
def test_sentencepiece_random(texts):
    memo = sentencepiece_backend.piece_memo(PIECES, 1)
    ids, off = memo.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [memo.own.encode(t) for t in texts]


def test_unigram_models(tmp_path):
    """A hand-made unigram model with scores and byte fallback."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, True, True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -3, 1), ("▁ab", -2, 1), ("c", -4, 1), ("a", -4, 1), ("b", -4, 1), ("bc", -3, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    memo = sentencepiece_backend.PieceMemo(str(path), 1)
    own = SentencePieceProcessor(model_file=str(path))
    texts = ["abc ab", "  a  bc ", "é", "", "cab abc"]
    ids, off = memo.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [own.encode(t) for t in texts]
