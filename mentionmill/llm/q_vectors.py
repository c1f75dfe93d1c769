"""Driver queries for vector search."""

from .ball_tree import top_inner_products
from .multi_index_hashing import nearest_neighbours


def op3_ball_tree(spark, sf_dir):
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scale=256)


def op5_multi_index_hashing(spark, sf_dir):
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


SQL3 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.x[i] * c.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op3_ball_tree": op3_ball_tree, "op5_multi_index_hashing": op5_multi_index_hashing}
ORACLES = {"op3_ball_tree": SQL3}
