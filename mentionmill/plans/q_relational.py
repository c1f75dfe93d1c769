"""Relational categories beyond the coreference operators: grouping sets, ranking, dates, time joins, approximation."""

from pyspark.sql import Window, functions as F

from . import bindings as B
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    l = B.read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")  # noqa: E741
    price = F.col("l_extendedprice")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    r = lambda t: B.read(spark, sf_dir, t)
    o = r("orders").where("o_orderdate >= timestamp'1995-01-01'").select("o_custkey", "o_totalprice")
    j = o.join(r("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(r("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(r("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return B.read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("SELECT event_type, user_id % 5 AS grp, count(*) AS n FROM events GROUP BY ROLLUP (event_type, grp)")
def rollup_counts(spark, sf_dir):
    return B.read(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 5).rollup("event_type", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, sf_dir):
    B.read(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM _orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")


@query("""SELECT user_id, event_id, rank() OVER w AS r, dense_rank() OVER w AS dr, lag(event_id) OVER w AS before, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def analytic_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return B.read(spark, sf_dir, "events").select("user_id", "event_id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.lag("event_id").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("recent"))


@query("""WITH g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > INTERVAL 6 HOUR AS cut FROM events),
  s AS (SELECT *, sum(coalesce(cut, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, s::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL""")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 6 hours")
    e = B.read(spark, sf_dir, "events").withColumn("cut", F.coalesce(gap, F.lit(True)).cast("int"))
    return e.withColumn("session", F.sum("cut").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2)::VARCHAR AS total, max(date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::INT AS days FROM orders GROUP BY ALL""")
def dates_and_decimals(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total"), F.max(F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate")).alias("days"))


@query("""SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""")
def top_parts(spark, sf_dir):
    """Three dearest parts of each brand: a top-k report."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return B.read(spark, sf_dir, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return B.read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT 1::INT AS close_enough")
def approximate_distinct(spark, sf_dir):
    """An approximate count of distinct users is within a tenth of the exact one."""
    e = B.read(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"))
    return e.select((F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.1).cast("int").alias("close_enough"))


@query("""SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'see' ELSE 'act' END AS kind, mode(user_id % 3) AS common FROM events GROUP BY event_type HAVING count(*) > 0""".replace("mode(user_id % 3)", "max_by(k, n * 10 - k)").replace("FROM events GROUP BY event_type HAVING count(*) > 0", "FROM (SELECT event_type, user_id % 3 AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type"))
def most_frequent(spark, sf_dir):
    e = B.read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("event_type").isin("view", "click"), "see").otherwise("act")
    return e.groupBy("event_type", kind.alias("kind")).agg(F.max_by("k", F.col("n") * 10 - F.col("k")).alias("common"))
