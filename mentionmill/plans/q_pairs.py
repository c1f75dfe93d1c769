"""Queries on pair generation, scopes and labels."""

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import filters, metrics, pairs
from ..sources import pair_store
from ..storage import new_path
from . import bindings as B
from .registry import query

_METRIC_COLS = "acc, precision, recall, f1, auc"
_XY = f"{B.MENTIONS} x JOIN {B.MENTIONS} y"


@query(
    B.rounded_sql(
        _METRIC_COLS,
        f"""SELECT *, {B.SCORES} FROM (SELECT topic, {B.COUNTS}, 0::BIGINT AS n_invalid FROM (
        SELECT x.topic, (x.gold = y.gold)::INT AS label,
          (list_sum([x.vector[i]::DOUBLE * y.vector[i]::DOUBLE FOR i IN range(1, 65)])
           / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN x.vector])) / sqrt(list_sum([v::DOUBLE * v::DOUBLE FOR v IN y.vector])) >= 0.12)::INT AS pred
        FROM {_XY} ON x.topic = y.topic AND x.pos < y.pos) GROUP BY topic)""",
        "topic, tp, fp, fn, tn, n_invalid",
    )
)
def pair_metrics_by_topic(spark, sf_dir):
    """Cross-document pairs of each topic, predicted by cosine similarity, against their gold tags."""
    m = B.mentions(spark, sf_dir, vector=True).select("topic", "pos", "gold", "vector")
    counts = ("tp", "fp", "fn", "tn", "n_invalid")

    def counted(t):
        label = pc.equal(t["m1_gold"], t["m2_gold"])
        y, known = pc.fill_null(label, False).to_numpy(), label.is_valid().to_numpy()
        pred = t["similarity"].to_numpy() >= 12.0
        n = [(y & pred).sum(), (known & ~y & pred).sum(), (y & ~pred).sum(), (known & ~y & ~pred).sum(), (~known).sum()]
        return pa.table({"topic": t["topic"][:1], **{c: pa.array([int(x)], pa.int64()) for c, x in zip(counts, n)}}) if len(t) else pa.table({c: pa.array([], pa.int64()) for c in ("topic", *counts)})

    tiles = pairs.similar_pairs(m, "topic", fold=counted, schema="topic long, " + ", ".join(f"{c} long" for c in counts))
    return B.rounded(metrics.with_scores(tiles.groupBy("topic").agg(*[F.sum(c).alias(c) for c in counts])))


def _by_sentences(p, *keys):
    """Pairs counted by their sentences, with the sums of their places; a table's pairs of tokens are too many for rows."""
    return p.groupBy("doc_id", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("links"), F.sum("m1_start").alias("m1_starts"), F.sum("m2_start").alias("m2_starts")
    )


_SUMS = "count(*) AS n, sum((x.gold = y.gold)::INT)::BIGINT AS links, sum(x.start)::BIGINT AS m1_starts, sum(y.start)::BIGINT AS m2_starts"


def within_document(spark, sf_dir):
    m = pairs.with_position(B.turn_mentions(spark, sf_dir).drop("pos"), "doc_id", ["sent_id", "start"])
    p = pairs.with_label(pairs.within_block(m, "doc_id"))
    return p.select("doc_id", F.col("m1_sent_id").alias("m1_sent"), F.col("m2_sent_id").alias("m2_sent"), "m1_start", "m2_start", "label")


@query(f"""SELECT x.doc_id, x.sent_id AS m1_sent, y.sent_id AS m2_sent, {_SUMS}
  FROM {B.TURN_MENTIONS} x JOIN {B.TURN_MENTIONS} y ON x.doc_id = y.doc_id AND x.pos < y.pos GROUP BY ALL""")
def pairs_within_document(spark, sf_dir):
    """All pairs of tokens of a document, counted by sentence pair."""
    return _by_sentences(within_document(spark, sf_dir), "m1_sent", "m2_sent")


@query(f"""SELECT x.topic, count(*) AS n, sum((x.gold = y.gold)::INT)::BIGINT AS links FROM {_XY} ON x.topic = y.topic AND x.pos < y.pos GROUP BY x.topic""")
def pairs_cross_document(spark, sf_dir):
    p = pairs.with_label(pairs.within_block(B.mentions(spark, sf_dir), "topic"))
    return p.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("links"))


def adjacent_sentences(spark, sf_dir):
    s = B.sentences(spark, sf_dir)
    m = pairs.with_sentence_ordinal(B.turn_mentions(spark, sf_dir), s)
    m = filters.tag_selected(m, s.where("role <> 'system'")).withColumnRenamed("is_selected", "selected")
    return pairs.with_label(pairs.adjacent_sentences(m))


@query(f"""WITH s AS (SELECT doc_id, sent_id, role <> 'system' AS selected, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) AS o FROM {B.SENTENCES}),
  m AS (SELECT t.*, s.o, s.selected FROM {B.TURN_MENTIONS} t JOIN s ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id)
  SELECT x.doc_id, x.sent_id AS m1_sent, y.sent_id AS m2_sent, {_SUMS} FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.pos < y.pos AND y.o - x.o <= 1
  WHERE x.selected AND y.selected GROUP BY ALL""")
def pairs_adjacent_sentences(spark, sf_dir):
    """Sentence-adjacent pairs, counted by sentence pair; unselected sentences (system turns) break the carry."""
    p = adjacent_sentences(spark, sf_dir)
    return _by_sentences(p.withColumnsRenamed({"m1_sent_id": "m1_sent", "m2_sent_id": "m2_sent"}), "m1_sent", "m2_sent")


def sliding_window(spark, sf_dir):
    s = B.sentences(spark, sf_dir)
    m = pairs.with_sentence_ordinal(B.turn_mentions(spark, sf_dir), s)
    return pairs.with_label(pairs.sliding_window(m, s))


@query(f"""WITH s AS (SELECT doc_id, sent_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS o, count(*) OVER (PARTITION BY doc_id) AS n FROM {B.SENTENCES}),
  m AS (SELECT t.doc_id, t.pos, t.start, t.gold, unnest(range(greatest(0, o - 1), least(o, greatest(0, n - 2)) + 1)) AS w
    FROM {B.TURN_MENTIONS} t JOIN s ON t.doc_id = s.doc_id AND t.sent_id = s.sent_id)
  SELECT x.doc_id, x.w AS "window", {_SUMS} FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.w = y.w AND x.pos < y.pos GROUP BY ALL""")
def pairs_sliding_window(spark, sf_dir):
    """Windows of two sentences, their pairs counted; a pair in one sentence comes once for each window that holds it."""
    return _by_sentences(sliding_window(spark, sf_dir), "window")


@query(f"""SELECT c.cluster, count(*) AS n FROM (SELECT DISTINCT doc_id, doc_id % 7 AS cluster FROM {B.MENTIONS}) c
  JOIN {B.MENTIONS} x ON x.doc_id = c.doc_id JOIN (SELECT m.*, m.doc_id % 7 AS cluster FROM {B.MENTIONS} m) y ON y.cluster = c.cluster AND x.pos < y.pos GROUP BY c.cluster""")
def pairs_predicted_topics(spark, sf_dir):
    m = B.mentions(spark, sf_dir)
    clusters = m.groupBy((F.col("doc_id") % 7).alias("cluster")).agg(F.collect_set("doc_id").alias("docs"))
    return pairs.predicted_topics(m, clusters).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT x.topic, count(*) AS n, count(*) FILTER (x.mention = y.mention) AS own FROM {_XY} ON x.topic = y.topic GROUP BY x.topic""")
def pairs_full_product(spark, sf_dir):
    p = pairs.full_product(B.mentions(spark, sf_dir), "topic")
    return p.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m1_mention") == F.col("m2_mention")).alias("own"))


@query(f"""WITH p AS (SELECT CASE WHEN x.doc_id = y.doc_id THEN 'wd' ELSE 'cd' END AS scope, CASE WHEN x.doc_id = y.doc_id THEN abs(x.sent_id - y.sent_id) END AS seq,
    (x.gold = y.gold)::INT AS label FROM {_XY} ON x.topic = y.topic AND x.pos < y.pos)
  SELECT '2s' AS name, count(*) AS n, sum(label)::BIGINT AS links FROM p WHERE scope = 'wd' AND seq <= 1
  UNION ALL SELECT 'wd-', count(*), sum(label)::BIGINT FROM p WHERE scope = 'wd' AND seq > 1 UNION ALL SELECT 'wd+', count(*), sum(label)::BIGINT FROM p WHERE scope = 'wd'
  UNION ALL SELECT 'cd-', count(*), sum(label)::BIGINT FROM p WHERE scope = 'cd' UNION ALL SELECT 'cd+', count(*), sum(label)::BIGINT FROM p""")
def pair_scopes(spark, sf_dir):
    """Pairs in each of the five scopes, counted in one pass over the mentions."""
    return pairs.scope_counts(B.mentions(spark, sf_dir), "topic")


@query(f"""SELECT x.doc_id, x.pos AS m1_pos, y.pos AS m2_pos FROM {_XY} ON x.doc_id = y.doc_id AND x.pos < y.pos WHERE abs(x.sent_id - y.sent_id) <= 1 AND y.sent_id - x.sent_id <= 1""")
def pairs_near_and_ordered(spark, sf_dir):
    """Adjacency by absolute and by signed sentence difference."""
    p = pairs.within_block(B.mentions(spark, sf_dir), "doc_id")
    return pairs.adjacent_signed(filters.near(p)).select("doc_id", "m1_pos", "m2_pos")


@query(f"""SELECT x.doc_id, x.mention AS a, y.mention AS b, (len(list_intersect([x.gold, x.topic + 100], [y.gold, y.topic + 200])) > 0)::INT AS label
  FROM {_XY} ON x.doc_id = y.doc_id AND x.pos < y.pos""")
def pair_label_by_overlap(spark, sf_dir):
    """Label by a common cluster of the two mentions' token clusters."""
    m = B.mentions(spark, sf_dir)
    base = m.select("doc_id", "mention", "pos", "gold", "topic")
    p = pairs.within_block(base, "doc_id")
    p = p.withColumn("m1_clusters", F.array(F.col("m1_gold").cast("long"), F.col("m1_topic") + 100)).withColumn("m2_clusters", F.array(F.col("m2_gold").cast("long"), F.col("m2_topic") + 200))
    return pairs.with_overlap_label(p).select("doc_id", F.col("m1_mention").alias("a"), F.col("m2_mention").alias("b"), "label")


@query("SELECT 0::BIGINT AS missing")
def within_document_subset_of_cross_document(spark, sf_dir):
    """Within-document pairs that the cross-document strategy lacks: none."""
    lost = pairs.strategy_subset(B.mentions(spark, sf_dir), "doc_id", "topic")
    return lost.agg(F.count(F.lit(1)).alias("missing"))


def _store(spark, sf_dir) -> str:
    m = B.mentions(spark, sf_dir).select("topic", "doc_id", "mention", "gold", "pos")
    table = f"mentions_{uuid.uuid4().hex[:12]}"
    pair_store.write_store(m, table, new_path(spark, "store"), buckets=8)
    return table


_STORED = "SELECT topic, count(*) AS n, count(*) FILTER (same) AS same FROM (SELECT x.topic, x.gold = y.gold AS same FROM {m} x JOIN {m} y ON x.doc_id = y.doc_id AND x.pos < y.pos) WHERE {w} GROUP BY topic"


def _counted(pairs_):
    return pairs_.groupBy(F.col("m1_topic").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m1_gold") == F.col("m2_gold")).alias("same"))


@query(_STORED.format(m=B.MENTIONS, w="topic IN (1, 4)"))
def stored_pairs_of_topics(spark, sf_dir):
    """Pairs from the bucketed store, of two topics; other topics' folders are not read."""
    return _counted(pair_store.stored_pairs(spark, _store(spark, sf_dir), [1, 4]))


@query(_STORED.format(m=B.MENTIONS, w="topic IN (SELECT r_regionkey + 2 FROM region WHERE r_name LIKE 'A%')"))
def stored_pairs_of_joined_topics(spark, sf_dir):
    """The same for topics that another table gives at run time."""
    topics = B.read(spark, sf_dir, "region").where("r_name like 'A%'").select((F.col("r_regionkey") + 2).cast("long").alias("topic"))
    return _counted(pair_store.stored_pairs(spark, _store(spark, sf_dir), topics))
