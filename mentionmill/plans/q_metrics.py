"""Queries on votes, binary metrics, sweeps and reports."""

from pyspark.sql import functions as F

from ..operators import filters, metrics
from . import bindings as B
from .registry import query

_METRIC_COLS = "acc, precision, recall, f1, auc"
_ANSWERS = """(SELECT user_id, user_id % 2 AS label, CASE event_type WHEN 'view' THEN ' Yes' WHEN 'click' THEN 'yes' WHEN 'signup' THEN 'No ' WHEN 'purchase' THEN 'no' ELSE 'maybe' END AS answer FROM events)"""
_VOTES = f"""(SELECT user_id, any_value(label) AS label, count(*) FILTER (lower(trim(answer)) = 'yes') AS yes, count(*) FILTER (lower(trim(answer)) IN ('yes', 'no')) AS valid, count(*) AS repeat,
  count(*) FILTER ((lower(trim(answer)) = 'yes' AND label = 1) OR (lower(trim(answer)) = 'no' AND label = 0)) AS correct FROM {_ANSWERS} GROUP BY user_id)"""


def _votes(spark, sf_dir):
    kinds = {"view": " Yes", "click": "yes", "signup": "No ", "purchase": "no"}
    a = F.lit("maybe")
    for k, v in kinds.items():
        a = F.when(F.col("event_type") == k, v).otherwise(a)
    rows = B.read(spark, sf_dir, "events").select("user_id", (F.col("user_id") % 2).alias("label"), a.alias("answer"))
    return metrics.vote_counts(rows, ["user_id", "label"], "answer", "label")


@query(f"SELECT user_id, label, yes, valid, repeat, correct FROM {_VOTES}")
def vote_counts(spark, sf_dir):
    return _votes(spark, sf_dir).select("user_id", "label", "yes", "valid", "repeat", "correct")


@query(f"""SELECT user_id, CASE WHEN valid = 0 THEN NULL WHEN correct * 2 >= valid THEN label ELSE 1 - label END::INT AS tie_right,
  CASE WHEN valid = 0 THEN NULL WHEN correct * 2 > valid THEN label ELSE 1 - label END::INT AS tie_wrong,
  coalesce((yes * 2 >= nullif(valid, 0))::INT, 0) AS by_yes, CASE WHEN label = 1 THEN yes ELSE valid - yes END AS from_yes FROM {_VOTES}""")
def vote_classes(spark, sf_dir):
    """Classes from votes under both tie rules, from the yes share, and the count converted between encodings."""
    v = _votes(spark, sf_dir)
    return v.select(
        "user_id", metrics.correct_share_to_class("label", "correct", "valid").alias("tie_right"),
        metrics.correct_share_to_class("label", "correct", "valid", "wrong").alias("tie_wrong"), metrics.yes_share_to_class("yes", "valid").alias("by_yes"),
        metrics.yes_to_correct("label", "yes", "valid").alias("from_yes"),
    )


@query(f"SELECT label, round(sum(valid)::DOUBLE / sum(repeat), 6) AS valid_share FROM {_VOTES} GROUP BY label")
def valid_share(spark, sf_dir):
    return B.rounded(metrics.valid_share(_votes(spark, sf_dir), ["label"]))


@query(B.rounded_sql(_METRIC_COLS, f"SELECT *, {B.SCORES} FROM (SELECT {B.COUNTS}, 0::BIGINT AS n_invalid FROM {B.LABELLED})", "tp, fp, fn, tn, n_invalid"))
def binary_metrics(spark, sf_dir):
    return B.rounded(metrics.binary_metrics(B.labelled(spark, sf_dir)))


@query(B.rounded_sql(_METRIC_COLS, f"SELECT *, {B.SCORES} FROM (SELECT lang, source, {B.COUNTS}, 0::BIGINT AS n_invalid FROM {B.LABELLED} GROUP BY lang, source)", "lang, source, tp, fp, fn, tn, n_invalid"))
def metrics_by_setting(spark, sf_dir):
    return B.rounded(metrics.binary_metrics(B.labelled(spark, sf_dir), ["lang", "source"]))


@query(B.rounded_sql(_METRIC_COLS, f"""SELECT *, {B.SCORES} FROM (SELECT bin, {B.COUNTS}, 0::BIGINT AS n_invalid FROM (
  SELECT *, floor((least(n_chars / 100.0, 100) + 5) / 10)::INT AS bin FROM {B.LABELLED}) GROUP BY bin)""", "bin, tp, fp, fn, tn, n_invalid"))
def metrics_by_similarity_bin(spark, sf_dir):
    rows = B.labelled(spark, sf_dir)
    return B.rounded(metrics.binary_metrics(rows.withColumn("bin", metrics.similarity_bin(F.least(F.col("n_chars") / 100, F.lit(100)))), ["bin"]))


@query(f"""WITH t AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {B.LABELLED} GROUP BY score),
  r AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () - sum(p) OVER (ORDER BY threshold DESC) AS fn FROM t)
  SELECT threshold, fp::BIGINT AS fp, fn::BIGINT AS fn, (fp + fn)::BIGINT AS errors FROM r""")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(B.labelled(spark, sf_dir))


@query(f"""WITH t AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {B.LABELLED} GROUP BY score),
  r AS (SELECT threshold, sum(n) OVER (ORDER BY threshold DESC) + sum(p) OVER () - sum(p) OVER (ORDER BY threshold DESC) AS errors FROM t)
  SELECT threshold, errors::BIGINT AS errors FROM r WHERE threshold > 0 ORDER BY errors, threshold DESC LIMIT 1""")
def best_pair_threshold(spark, sf_dir):
    return metrics.best_threshold(metrics.threshold_sweep(B.labelled(spark, sf_dir)))


@query(f"""SELECT doc_id, CASE WHEN n1 + n2 + n3 = 0 THEN NULL ELSE ((coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0)) * 2 > n1 + n2 + n3)::INT END AS majority,
  round((coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0))::DOUBLE / nullif(n1 + n2 + n3, 0), 6) AS mean FROM (
  SELECT *, (p1 IS NOT NULL)::INT AS n1, (p2 IS NOT NULL)::INT AS n2, (p3 IS NOT NULL)::INT AS n3 FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN pred END AS p1, CASE WHEN doc_id % 7 <> 0 THEN toxic END AS p2, CASE WHEN doc_id % 2 = 0 THEN label END AS p3 FROM {B.LABELLED}))""")
def prompt_aggregates(spark, sf_dir):
    """Majority and mean over several prompts, those without an answer left out."""
    r, d = B.labelled(spark, sf_dir), F.col("doc_id")
    r = r.select("doc_id", F.when(d % 5 != 0, F.col("pred")).alias("p1"), F.when(d % 7 != 0, F.col("toxic")).alias("p2"), F.when(d % 2 == 0, F.col("label")).alias("p3"))
    cols = ["p1", "p2", "p3"]
    return B.rounded(r.select("doc_id", metrics.majority(cols).alias("majority"), metrics.mean_of(cols).alias("mean")))


@query(f"""SELECT source, count(*) FILTER (label = pred AND pred = 1) AS "TP", count(*) FILTER (label = pred AND pred = 0) AS "TN", count(*) FILTER (label <> pred AND pred = 1) AS "FP",
  count(*) FILTER (label <> pred AND pred = 0) AS "FN" FROM {B.LABELLED} GROUP BY source""")
def cell_labels(spark, sf_dir):
    c = B.labelled(spark, sf_dir).select("source", metrics.cell().alias("cell"))
    return c.groupBy("source").agg(*[F.count_if(F.col("cell") == x).alias(x) for x in ("TP", "TN", "FP", "FN")])


@query(f"""SELECT label, least(floor(least(n_chars / 4000.0, 1.0) * 20), 19)::INT AS bin, count(*) AS n FROM {B.LABELLED} GROUP BY ALL""")
def prediction_distribution(spark, sf_dir):
    rows = B.labelled(spark, sf_dir).withColumn("p", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return metrics.distribution(rows, "p", "label")


@query(B.rounded_sql(_METRIC_COLS, f"""SELECT *, {B.SCORES} FROM (SELECT a.t AS type_1, b.t AS type_2, {B.COUNTS} FROM
  (SELECT unnest(['en', 'fr', 'de', 'es', 'xx']) AS t) a CROSS JOIN (SELECT unnest(['src0', 'src1', 'src2', 'src3', 'en']) AS t) b
  LEFT JOIN {B.LABELLED} p ON p.lang = a.t OR p.source = b.t GROUP BY ALL)""", "type_1, type_2, tp, fp, fn, tn"))
def type_matrix(spark, sf_dir):
    """Metrics of the rows in which either side has its type, for all pairs of types."""
    rows = B.labelled(spark, sf_dir)
    types = ["en", "fr", "de", "es", "xx", "src0", "src1", "src2", "src3"]
    m = metrics.type_matrix(rows, types, "lang", "source")
    return B.rounded(m.where(F.col("type_1").isin("en", "fr", "de", "es", "xx") & F.col("type_2").isin("src0", "src1", "src2", "src3", "en")))


@query(B.rounded_sql(_METRIC_COLS, f"SELECT *, {B.SCORES} FROM (SELECT lang AS pos1, source AS pos2, {B.COUNTS}, 0::BIGINT AS n_invalid FROM {B.LABELLED} GROUP BY ALL)", "pos1, pos2, tp, fp, fn, tn, n_invalid"))
def category_matrix(spark, sf_dir):
    """Metrics where both sides have their category."""
    rows = B.labelled(spark, sf_dir).withColumnRenamed("lang", "pos1").withColumnRenamed("source", "pos2")
    return B.rounded(metrics.binary_metrics(rows, ["pos1", "pos2"]))


@query(f"""WITH s AS (SELECT lang, 's' || (doc_id % 3) AS setting, {B.COUNTS} FROM {B.LABELLED} GROUP BY ALL),
  t AS (SELECT lang, setting, printf('%.4f', coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) AS v FROM s)
  SELECT lang, coalesce(max(v) FILTER (setting = 's0'), '-') AS s0, coalesce(max(v) FILTER (setting = 's1'), '-') AS s1, coalesce(max(v) FILTER (setting = 's9'), '-') AS s9 FROM t GROUP BY lang""")
def pivot_report(spark, sf_dir):
    rows = B.labelled(spark, sf_dir).withColumn("setting", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    m = metrics.binary_metrics(rows, ["lang", "setting"])
    return metrics.pivot_report(m, ["lang"], "setting", ["s0", "s1", "s9"], metrics.f1_text())


@query(f"""SELECT doc_id, label, pred FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM {B.LABELLED}) WHERE rn <= 20""")
def balanced_sample(spark, sf_dir):
    """The first rows of each label, in source order."""
    return filters.balanced_first(B.labelled(spark, sf_dir), 40, "label", "doc_id").select("doc_id", "label", "pred")


@query(f"""SELECT source, label, min(doc_id) AS doc_id FROM {B.LABELLED} GROUP BY ALL""")
def first_examples(spark, sf_dir):
    return filters.first_example(B.labelled(spark, sf_dir), ["source"], "label", "doc_id").select("source", "label", "doc_id")


@query(f"""SELECT doc_id, (score >= 150)::INT AS pred FROM {B.LABELLED} WHERE lang IN ('en', 'fr') AND label IS NOT NULL""")
def thresholded_subset(spark, sf_dir):
    """Subset by name, rows without a value dropped, probabilities cut."""
    rows = filters.topics(filters.drop_header_rows(B.labelled(spark, sf_dir).withColumn("l", F.col("label").cast("string")), "l"), ["en", "fr"], "lang").dropna(subset=["label"])
    return rows.select("doc_id", filters.probability_to_class("score", 150.0).alias("pred"))
