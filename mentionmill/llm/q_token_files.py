"""Driver query for Simple-8b token files."""

import public_tokenizers

from ..storage import new_path
from .token_files import read_token_files, write_token_files


def op7_simple8b(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "tokens")
    manifest = write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder, manifest)


QUERIES = {"op7_simple8b": op7_simple8b}
ORACLES = {}
