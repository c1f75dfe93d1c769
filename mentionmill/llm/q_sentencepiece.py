"""Driver query for SentencePiece encoding."""

import public_tokenizers

from .sentencepiece_backend import encode_pieces


def op8_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES = {}
