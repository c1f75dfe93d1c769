"""Driver query for best-fit packing."""

import public_tokenizers

from .packing import pack, piece_rows

CAPACITY, END = 4096, 1


def packed(docs):
    return pack(piece_rows(docs, public_tokenizers.path("word_bpe_49k.json"), END, CAPACITY), CAPACITY)


def op10_best_fit(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_best_fit": op10_best_fit}
ORACLES = {}
