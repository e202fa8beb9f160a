"""Relational coverage over the star-schema tables and events (extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.streaming import streams


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    grouped = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.sum(price).alias("revenue"), F.avg("l_discount").alias("disc"), F.count("*").alias("n"))
    return grouped.select("l_returnflag", "l_linestatus", F.round("qty", 2).alias("qty"), F.round("revenue", 2).alias("revenue"), F.round("disc", 6).alias("disc"), "n")


def revenue_by_nation(spark, sf_dir):
    li, o, c, n = (_t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def customers_without_orders(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def customers_with_urgent(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where(F.col("o_orderpriority").startswith("1"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def nation_outer(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    rows = s.join(c, s.s_nationkey == c.c_nationkey, "full")
    return rows.select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


def sales_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "gid", "n")


def part_cube(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce("p_size", F.lit(-1)).alias("size"), "n")


def top_orders(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "r")


def order_ranks(spark, sf_dir):
    w = W.partitionBy("o_orderpriority").orderBy("o_orderdate")
    rows = _t(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(W.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")).alias("q"))


def set_operations(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    b = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("op"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("op"), "k")).unionByName(a.union(b).distinct().select(F.lit("any").alias("op"), "k"))


def distinct_parts(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey", "l_linenumber").alias("pairs"))


def event_windows(spark, sf_dir):
    rows = streams.event_windows(_t(spark, sf_dir, "events"), "1 day")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    rows = streams.sessions(_t(spark, sf_dir, "events"), "30 minutes")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def event_props(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", F.size(F.json_object_keys("props")).alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


QUERIES = {
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2)::DOUBLE AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, round(avg(l_discount), 6)::DOUBLE AS disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "revenue_by_nation": (revenue_by_nation, "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "customers_without_orders": (customers_without_orders, "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1"),
    "customers_with_urgent": (customers_with_urgent, "SELECT c_nationkey, count(*)::BIGINT AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') GROUP BY 1"),
    "nation_outer": (nation_outer, "SELECT coalesce(s.k, c.k) AS nation, coalesce(s.n, 0)::BIGINT AS suppliers, coalesce(c.n, 0)::BIGINT AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.k = c.k"),
    "sales_rollup": (sales_rollup, "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, grouping(l_returnflag, l_linestatus)::INT AS gid, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "part_cube": (part_cube, "SELECT coalesce(p_brand, '*') AS brand, coalesce(p_size, -1) AS size, count(*)::BIGINT AS n FROM part GROUP BY CUBE (p_brand, p_size)"),
    "top_orders": (top_orders, "SELECT o_custkey, o_orderkey, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2"),
    "order_ranks": (order_ranks, "SELECT o_orderkey, rank() OVER w::INT AS rk, dense_rank() OVER w::INT AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::INT AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)"),
    "set_operations": (set_operations, "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0) SELECT 'both' AS op, k FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', k FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', k FROM (SELECT * FROM a UNION SELECT * FROM b)"),
    "distinct_parts": (distinct_parts, "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, count(DISTINCT (l_suppkey, l_linenumber))::BIGINT AS pairs FROM lineitem GROUP BY 1"),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions, count(*)::BIGINT AS events FROM g GROUP BY 1"),
    "event_props": (event_props, "SELECT event_type, len(json_keys(props))::INT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"),
}
