"""Streaming additions, run over what is there now."""

from pyspark.sql import functions as F

from ..operators import pairs
from ..operators.predictors import KeywordPredictor
from ..storage import new_path
from ..streaming import chains, joins, scoring
from ..streaming.answers import AnswerLog
from ..streaming.runs import Closing, Output
from . import bindings as B
from .q_graph import _CC, _NODES
from .registry import query


def _events(spark, sf_dir):
    return scoring.read_stream(spark, sf_dir, "events")


@query("SELECT event_type, count(*) FILTER (l = 1 AND p = 1) AS tp, count(*) FILTER (l = 0 AND p = 1) AS fp, count(*) FILTER (l = 1 AND p = 0) AS fn, count(*) FILTER (l = 0 AND p = 0) AS tn, 0::BIGINT AS n_invalid FROM (SELECT event_type, (user_id % 2)::INT AS l, (value > 10)::INT AS p FROM events) GROUP BY event_type")
def streaming_confusion(spark, sf_dir):
    """Running confusion counts of a stream of predictions, in update mode into files."""
    e = _events(spark, sf_dir).select("event_type", (F.col("user_id") % 2).cast("int").alias("label"), (F.col("value") > 10).cast("int").alias("pred"))
    out = Output(spark, "confusion")
    out.update(scoring.running_confusion(e, ["event_type"]))
    return out.latest(["event_type"])


def _closed(spark, stream, build, label, **marks):
    """A stream of times ``ts`` run into files in append mode until it is closed."""
    end, out = Closing(stream, "ts", **marks), Output(spark, label)
    df = build(end.rows)
    end.close(lambda: out.append(df))
    return out.read()


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_windows(spark, sf_dir):
    """Windowed counts with a watermark, each window written once it is closed."""
    got = _closed(spark, _events(spark, sf_dir), lambda e: scoring.windowed_counts(e, size="1 day", late="40 days", by=["event_type"]), "windows")
    return got.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOURS AS apart FROM events),
  s AS (SELECT user_id, ts, sum(coalesce(apart, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def streaming_sessions(spark, sf_dir):
    """Sessions of each user, parted by six hours without an event."""
    got = _closed(spark, _events(spark, sf_dir), lambda e: scoring.sessions(e, "user_id", gap="6 hours", late="40 days"), "sessions")
    return got.select("user_id", "start", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_distinct(spark, sf_dir):
    """The first event of each user and type of a stream."""
    out = Output(spark, "distinct")
    out.append(scoring.dedupe_stream(_events(spark, sf_dir), ["user_id", "event_type"], late="40 days").select("user_id", "event_type"))
    return out.read()


@query(_CC.format(edges=f"SELECT block AS k, a, b FROM {B.PREDICTIONS} WHERE pred", nodes=_NODES))
def streaming_chains(spark, sf_dir):
    """Chains of predictions that arrive out of order in several batches, the stream stopped and started again in between."""
    p = B.predictions(spark, sf_dir)
    minutes = (F.col("a") * 7 + F.col("b") * 3) % 50
    rows = p.select("block", "a", "b", F.col("pred").cast("double").alias("score"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("at"))
    folder, out = new_path(spark, "arriving"), Output(spark, "chains")
    files = pairs.tasks_of_pairs(B.mentions(spark, sf_dir), "doc_id", least=3)
    part = lambda k: rows.where((F.col("a") + F.col("b")) % 2 == k).coalesce(files).write.mode("append").parquet(folder)
    part(0)
    end = Closing(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-2 * files // 3)).parquet(folder), "at")
    df = chains.growing_chains(end.rows, 1.0)
    with chains.state_in_rocksdb(spark):
        out.append(df)
        part(1)
        end.close(lambda: out.append(df))
    return out.read().where("final").select("block", "mention", "cluster")


_PAIRED = "FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v {} JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOURS"


def _kinds(e):
    return (e.where(F.col("event_type").isin(k) | F.col("event_type").isNull()).select("event_id", "user_id", "ts") for k in ("view", "purchase"))


def _within_streams(spark, sf_dir, outer):
    join = lambda e: joins.stream_within(*_kinds(e), "user_id", "ts", 12 * 3600, late="40 days", outer=outer)
    return _closed(spark, _events(spark, sf_dir), join, "within", user_id=-1, event_id=-1).where("l_event_id >= 0").select(F.col("l_event_id").alias("view"), F.col("r_event_id").alias("purchase"))


@query(f"SELECT v.event_id AS view, p.event_id AS purchase {_PAIRED.format('')}")
def streaming_views_to_purchases(spark, sf_dir):
    """Purchases of a user within twelve hours of a view; both streams have watermarks."""
    return _within_streams(spark, sf_dir, False)


@query(f"SELECT v.event_id AS view, p.event_id AS purchase {_PAIRED.format('LEFT')}")
def streaming_views_with_or_without_purchases(spark, sf_dir):
    """The same, with views that no purchase follows, once no purchase can come."""
    return _within_streams(spark, sf_dir, True)


@query(f"SELECT v.event_id AS view, p.event_id AS purchase {_PAIRED.format('LEFT')}")
def views_with_or_without_purchases(spark, sf_dir):
    """The join by time of tables, bucket by bucket."""
    got = joins.within(*_kinds(B.read(spark, sf_dir, "events")), "user_id", "ts", 12 * 3600, outer=True)
    return got.select(F.col("l_event_id").alias("view"), F.col("r_event_id").alias("purchase"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'Yes' ELSE 'No' END AS answer FROM conversations")
def resumable_answers(spark, sf_dir):
    """Every turn asked once in several batches; a second run finds nothing to ask."""
    rows = B.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    folder = new_path(spark, "prompts")
    rows.repartition(3, "conv_id").write.parquet(folder)
    prompts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    log = AnswerLog(spark, new_path(spark, "answers"), KeywordPredictor("the"))
    log.run(prompts)
    log.run(prompts)
    return log.read().select("conv_id", "turn", "answer")
