"""All driver queries of this subpackage, and their SQL."""

from . import q_jaccard, q_language, q_late_overwrite, q_packing, q_periodic_runs, q_quality, q_secrets, q_sentencepiece, q_token_files, q_toxicity, q_vectors, q_warc

_MODULES = [q_warc, q_jaccard, q_vectors, q_language, q_secrets, q_token_files, q_sentencepiece, q_toxicity, q_packing, q_quality, q_late_overwrite, q_periodic_runs]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
