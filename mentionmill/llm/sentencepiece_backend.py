"""SentencePiece models run by the tokenizers library.

``rebuild`` parses the model protobuf and builds an equal tokenizers pipeline:

* normaliser: the model's precompiled character map if it has one, white-space
  rules, then the metaspace marker for spaces (dummy prefix if the model asks);
* model: unigram with its scores, or BPE with merges rebuilt from the scores,
  both with byte fallback where the model has it;
* pre-tokenizer: a cut before every run of markers.  No piece holds a marker
  after another character (checked), so cuts lose nothing.

Documents are encoded by distinct chunk, in batches and with the library's
threads; a bounded memo keeps chunks.  Parity is verified on every whole text
against the sentencepiece library, and the ids are decoded again.

Nulls are encoded as empty texts (no ids); rows are kept as they come.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texthash import Lanes, blocks, joined, small_batches, word_spans
from .tokenmemo import MEMO_BYTES, ByteTable

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_CHUNKS = 800_000
LONG = 1 << 22
_BLANK = re.compile(r"(?<=\S) (?=\S)")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_OPEN: dict = {}


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return m


def bpe_merges(pieces: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """Merges of a BPE vocabulary: every split of a piece into two pieces, best score first."""
    vocab = {p for p, _ in pieces}
    out = []
    for rank, (p, _) in enumerate(sorted(pieces, key=lambda x: -x[1])):
        out += [(rank, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
    return [(a, b) for _, _, a, b in sorted(out, key=lambda x: (x[0], x[1]))]


def rebuild(path: str):
    """(tokenizer without normaliser, function text -> marked text, model) for a model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse_model(path)
    ns, ts = m.normalizer_spec, m.trainer_spec
    vocab = {p.piece: i for i, p in enumerate(m.pieces)}
    if any(MARK in p.piece.lstrip(MARK) for p in m.pieces) or ts.treat_whitespace_as_suffix:
        raise ValueError("a piece holds a marker inside; chunks would change its ids")
    unk = next(p.piece for p in m.pieces if p.type == UNKNOWN)
    if ts.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in m.pieces], vocab[unk], ts.byte_fallback)
    else:
        merges = bpe_merges([(p.piece, p.score) for p in m.pieces if p.type in (NORMAL, USER)])
        model = models.BPE(vocab, merges, unk_token=unk, fuse_unk=True, byte_fallback=ts.byte_fallback)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    charsmap = normalizers.Precompiled(bytes(ns.precompiled_charsmap)) if ns.precompiled_charsmap else None

    def marked(text: str) -> str:
        if charsmap:
            text = charsmap.normalize_str(text)
        if ns.remove_extra_whitespaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if ns.add_dummy_prefix else "") + text.replace(" ", MARK)

    return tok, marked, m


class PieceMemo:
    """Encoder of batches of texts with a bounded memo of chunks.

    Where a text's gaps are single blanks or line ends (and the model neither
    maps characters nor trims), its chunks are words with or without a marker
    before them, and line ends; they are looked up in numpy by a 64-bit hash and
    their bytes.  Other texts are cut by the chunk pattern and looked up one by one.
    """

    def __init__(self, path: str, threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        self.tok, self.marked, self.model = rebuild(path)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, ns = self.model.pieces, self.model.normalizer_spec
        self.text = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode()
            for p in pieces
        ]
        size = [len(t) for t in self.text]
        self.byte, self.byte_size = np.frombuffer(b"".join(self.text), np.uint8), np.array(size, np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        line_end = any("\n" in p.piece and p.type != BYTE for p in pieces)
        self.direct = not (ns.precompiled_charsmap or ns.remove_extra_whitespaces or line_end) and ns.add_dummy_prefix
        self.clear()

    def clear(self):
        self.table, self.index = ByteTable(), {}
        self.flat, self.start, self.size = np.empty(0, np.uint16), np.empty(0, np.int32), np.empty(0, np.int32)
        self.place = np.zeros(1 << 16, np.int32)  # where the chunks of the table's numbers are in the memo
        self.line = int(self._add(["\n"])[0])

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Encode new chunks; their places in the memo."""
        ids = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.array([len(i) for i in ids], np.int32)
        at = np.arange(len(self.start), len(self.start) + len(ids))
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes])
        kind = np.uint16 if len(self.text) < 1 << 16 else np.uint32
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), kind, int(sizes.sum()))])
        return at

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.flat[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])], total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n+1 offsets."""
        if len(self.start) > MEMO_CHUNKS or self.table.used > MEMO_BYTES:
            self.clear()
        texts = [t or "" for t in texts]
        if self.direct and any(len(t) > LONG for t in texts):
            return self._encode_long(texts)
        data, off = joined(texts)
        s, e = word_spans(data)
        first = np.searchsorted(s, off)
        # a word's gap: what stands before it; a text's own start counts as a blank
        gap = np.full(len(s), 2, np.int8)
        before = data[np.maximum(s - 1, 0)]
        gap[before == 32] = 1
        gap[before == 10] = 0
        wide = np.concatenate([[False], s[1:] - e[:-1] > 1])
        heads = first[:-1][np.diff(first) > 0]
        wide[heads] = False
        odd = wide | (gap == 2)
        odd[heads] = False
        bad = np.zeros(len(texts), bool)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        bad[text_of[odd]] = True
        empty = np.diff(first) == 0
        # blanks at either end, or none but blanks
        lead = np.zeros(len(texts), bool)
        some = np.flatnonzero(~empty)
        lead[some] = (s[first[:-1][some]] != off[:-1][some]) | (e[first[1:][some] - 1] != off[1:][some] - 1)
        bad |= lead | (empty & (np.diff(off) > 1))
        if not self.direct:
            bad[:] = True
        gap[heads] = 1
        use = ~bad[text_of]
        own = np.flatnonzero(use)
        numbers, new = self.table.number(Lanes(data), s[own], e[own], (gap[own] == 1).astype(np.int8))
        if len(new):
            raw, new = data.tobytes(), own[new]
            words = [(MARK if g else "") + raw[x:y].decode("utf-8", "surrogatepass") for x, y, g in zip(s[new].tolist(), e[new].tolist(), gap[new].tolist())]
            if self.table.count > len(self.place):
                self.place = np.concatenate([self.place, np.zeros(self.table.count, np.int32)])
            self.place[self.table.count - len(new) : self.table.count] = self._add(words)
        place = np.full(len(s), -1, np.int64)
        place[own] = self.place[numbers]
        chunks, counts = [], np.zeros(len(texts), np.int64)
        units = np.where(gap == 0, 2, 1)
        units[~use] = 0
        counts += np.bincount(text_of, units, len(texts)).astype(np.int64) if len(text_of) else 0
        for i in np.flatnonzero(bad):
            own = _CHUNK.findall(self.marked(texts[i]))
            chunks.append(own)
            counts[i] = len(own)
        bound = np.concatenate([[0], np.cumsum(counts)])
        at = np.empty(bound[-1], np.int64)
        slow = np.repeat(bad, counts)
        fast = np.repeat(place[use], units[use])
        if len(fast):
            ends = np.cumsum(units[use])
            fast[(ends - units[use])[units[use] == 2]] = self.line
        at[~slow] = fast
        if chunks:
            flat = list(chain.from_iterable(chunks))
            fresh = sorted({c for c in flat if c not in self.index})
            if fresh:
                self.index.update(zip(fresh, self._add(fresh).tolist()))
            at[slow] = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        ids, total = self._gather(at)
        return ids, total[bound]

    def _encode_long(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with long texts cut at single blanks, which the dummy prefix stands for again."""
        parts, sizes = [], [0]
        for t in texts:
            own, at = [], 0
            while len(t) - at > LONG and (cut := _BLANK.search(t, at + LONG * 3 // 4)):
                own.append(t[at : cut.start()])
                at = cut.end()
            got = [self.encode([p])[0] if len(p) <= LONG else np.array(self.tok.encode(self.marked(p)).ids) for p in (*own, t[at:])]
            parts += got
            sizes.append(sum(map(len, got)))
        return np.concatenate(parts).astype(np.uint32), np.cumsum(sizes)

    def decode(self, ids: list[int]) -> str:
        return self._strip(b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace"))

    def _strip(self, text: str) -> str:
        return text[1:] if self.model.normalizer_spec.add_dummy_prefix and text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of several runs of ids."""
        size = self.byte_size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        raw = self.byte[np.repeat(self.byte_start[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = total[off].tolist()
        return [self._strip(raw[a:b].decode("utf-8", "replace")) for a, b in zip(cut[:-1], cut[1:])]


def piece_memo(path: str, threads: int) -> PieceMemo:
    if (path, threads) not in _OPEN:
        _OPEN[path, threads] = PieceMemo(path, threads)
    return _OPEN[path, threads]


def encode_pieces(
    docs: DataFrame, model: str, threads: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, parity, round_trip`` (and ``ids``) of every document.

    ``parity``: the sentencepiece library gives the same ids for the whole text.
    ``round_trip``: decoding the ids gives the normalised text again.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(batches):
        memo = piece_memo(model, threads)
        prefix = memo.model.normalizer_spec.add_dummy_prefix
        for batch in batches:
            for own, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, off = memo.encode(texts)
                ids = ids.astype("<u4")
                back = memo.decode_all(ids, off)
                rows = []
                for d, t, plain, a, b in zip(own, texts, back, off[:-1].tolist(), off[1:].tolist()):
                    got = ids[a:b]
                    want = np.array(memo.own.encode(t or "", num_threads=1), "<u4")
                    rows.append((d, b - a, zlib.crc32(got.data), np.array_equal(got, want), plain == memo.marked(t or "").replace(MARK, " ")[1 if prefix else 0 :]))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int64())))
                    yield pa.record_batch(columns, schema=schema)

    out = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<long>" * with_ids
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, out)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        memo = piece_memo(model, 1)
        for batch in batches:
            texts = [None if i is None else memo.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
