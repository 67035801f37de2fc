"""General queries over the star schema: aggregation, joins, ranking, anti joins, time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import latest, top_per_group
from quarry.sources import table


def _cents(c):
    return F.round(F.sum(c), 2)


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        _cents("l_quantity").alias("sum_qty"), _cents(net).alias("sum_net"), F.count("*").alias("n_lines")
    )


def nation_revenue(spark: SparkSession, folder: str) -> DataFrame:
    li, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    cust, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(_cents(net).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))
    )


def top_orders_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def latest_event(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return orders.join(li, orders.o_orderkey == li.l_orderkey, "left_anti").select("o_orderkey", "o_orderstatus")


def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")
    return table(spark, folder, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {f.__name__: f for f in (pricing_summary, nation_revenue, top_orders_per_customer, latest_event, orders_without_lines, events_by_day)}

ORACLES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "nation_revenue": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "top_orders_per_customer": """
        SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
        WHERE rank <= 3""",
    "latest_event": """
        SELECT user_id, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "orders_without_lines": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "events_by_day": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users
        FROM events GROUP BY ALL""",
}
