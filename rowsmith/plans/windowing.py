"""Window functions over hot partition keys: a few priorities, statuses and event types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators import windows as W
from rowsmith.plans.registry import Tables, query
from rowsmith.plans.relational import money


def orders_by_price(t: Tables, descending: bool = False) -> W.BucketedWindow:
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return W.BucketedWindow(
        orders, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], descending=descending
    )


def events_by_time(t: Tables) -> W.BucketedWindow:
    events = t.events.select("event_id", "event_type", "ts", money("value").alias("amount"))
    return W.BucketedWindow(events, ["event_type"], ["ts", "event_id"])


@query(
    "win_row_number",
    "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY"
    " o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders",
)
def win_row_number(t: Tables) -> DataFrame:
    return W.row_number(orders_by_price(t, descending=True), "rn")


def lines_by_quantity(t: Tables) -> W.BucketedWindow:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return W.BucketedWindow(lines, ["l_returnflag"], ["l_quantity"])


@query(
    "win_rank",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, rank() OVER (PARTITION BY"
    " l_returnflag ORDER BY l_quantity) AS rnk FROM lineitem",
)
def win_rank(t: Tables) -> DataFrame:
    return W.rank(lines_by_quantity(t), "l_quantity", "rnk")


@query(
    "win_dense_rank",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, dense_rank() OVER (PARTITION BY"
    " l_returnflag ORDER BY l_quantity) AS rnk FROM lineitem",
)
def win_dense_rank(t: Tables) -> DataFrame:
    return W.dense_rank(lines_by_quantity(t), "l_quantity", "rnk")


@query(
    "win_ntile",
    "SELECT o_orderkey, o_orderpriority, o_totalprice, ntile(7) OVER (PARTITION BY o_orderpriority"
    " ORDER BY o_totalprice, o_orderkey) AS tile FROM orders",
)
def win_ntile(t: Tables) -> DataFrame:
    return W.ntile(orders_by_price(t), 7, "tile")


@query(
    "win_lag_lead",
    "SELECT event_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS amount,"
    " lag(CAST(value AS DECIMAL(18,2))) OVER w AS previous,"
    " lead(CAST(value AS DECIMAL(18,2))) OVER w AS following FROM events"
    " WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)",
)
def win_lag_lead(t: Tables) -> DataFrame:
    return W.lag_lead(events_by_time(t), "amount", "previous", "following")


@query(
    "win_first_last",
    "SELECT event_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS amount,"
    " first_value(event_id) OVER w AS first_event, last_value(event_id) OVER w AS last_event"
    " FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
def win_first_last(t: Tables) -> DataFrame:
    return W.first_last(events_by_time(t), "event_id", "first_event", "last_event")


@query(
    "win_agg",
    "SELECT o_orderkey, o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER"
    " (PARTITION BY o_orderstatus) AS DOUBLE) AS status_total, COUNT(*) OVER"
    " (PARTITION BY o_orderstatus) AS status_orders FROM orders",
)
def win_agg(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("price"))
    return W.partition_aggregate(
        orders,
        ["o_orderstatus"],
        F.sum("price").cast("double").alias("status_total"),
        F.count("*").alias("status_orders"),
    ).drop("price")


@query(
    "win_running_sum",
    "SELECT event_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS amount,"
    " CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id"
    " ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM events",
)
def win_running_sum(t: Tables) -> DataFrame:
    summed = W.running_sum(events_by_time(t), "amount", "running")
    return summed.withColumn("running", F.col("running").cast("double"))


@query(
    "win_rows_frame",
    "SELECT event_id, event_type, ts, CAST(value AS DECIMAL(18,2)) AS amount,"
    " CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS near_sum,"
    " MAX(CAST(value AS DECIMAL(18,2))) OVER w AS near_max FROM events"
    " WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id"
    " ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
)
def win_rows_frame(t: Tables) -> DataFrame:
    aggregates = {"near_sum": F.sum("amount"), "near_max": F.max("amount")}
    framed = W.rows_frame(events_by_time(t), aggregates, 2, 1, chunk_rows=500)
    return framed.withColumn("near_sum", F.col("near_sum").cast("double"))


@query(
    "win_range_frame",
    "SELECT event_id, event_type, ts, COUNT(*) OVER w AS last_hour, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER w"
    " AS DOUBLE) AS hour_sum, MIN(CAST(value AS DECIMAL(18,2))) OVER w AS hour_min,"
    " MAX(CAST(value AS DECIMAL(18,2))) OVER w AS hour_max FROM events WINDOW w AS (PARTITION BY event_type ORDER BY"
    " CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)",
)
def win_range_frame(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "event_type", "ts", money("value").alias("amount"))
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    aggregates = {"last_hour": ("count", "*"), "hour_sum": ("sum", "amount"), "hour_min": ("min", "amount"), "hour_max": ("max", "amount")}
    framed = W.range_frame(events, ["event_type"], second, 3600, aggregates)
    return framed.drop("amount").withColumn("hour_sum", F.col("hour_sum").cast("double"))


@query(
    "win_named",
    "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER w AS rn,"
    " lag(o_orderkey) OVER w AS cheaper, lead(o_orderkey) OVER w AS dearer FROM orders"
    " WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
)
def win_named(t: Tables) -> DataFrame:
    return W.lag_lead(orders_by_price(t), "o_orderkey", "cheaper", "dearer", number="rn")
