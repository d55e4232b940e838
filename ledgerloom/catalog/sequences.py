"""Sequences within sessions, row numbers, first rows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import COVIEW_SQL, PRODUCT_EVENTS_SQL, product_events
from ledgerloom.operators import sequence as S
from ledgerloom.plans.coview import coview_graph as build_graph, graph_nodes as nodes_of

_NEXT = f"""
WITH {PRODUCT_EVENTS_SQL}
SELECT event_id, lead(product_id, 1, -1) OVER (PARTITION BY user_session ORDER BY event_time, event_id) AS next_value FROM e
"""


@query(_NEXT)
def next_in_session(spark, d):
    led = S.next_in_session(product_events(spark, d), "user_session", ["event_time", "event_id"], "product_id")
    return led.select("event_id", "next_value")


@query(_NEXT.replace("PARTITION BY user_session", "PARTITION BY event_type"))
def next_in_large_session(spark, d):
    """The same over few large groups, which are cut into ranges."""
    led = S.next_in_session(
        product_events(spark, d), "event_type", ["event_time", "event_id"], "product_id", hot_rows=500
    )
    return led.select("event_id", "next_value")


@query('SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS "ID", o_orderkey FROM orders')
def row_ids(spark, d):
    """Row numbers 1..n in a given order."""
    orders = table(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return S.with_row_id(orders, ["o_totalprice", "o_orderkey"]).select("ID", "o_orderkey")


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top_rows(spark, d):
    return S.top_k(table(spark, d, "events").select("event_id", "user_id", "value"), [F.desc("value"), F.asc("event_id")], 10)


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def dedup_first(spark, d):
    """First order of each customer."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return S.dedup_first(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem
""")
def union_all(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("amount"), F.col("l_orderkey").alias("id"))
    return a.unionByName(b)


@query(f"WITH {COVIEW_SQL} SELECT pid_1 AS node FROM edges UNION SELECT pid_2 FROM edges")
def graph_nodes(spark, d):
    return nodes_of(build_graph(product_events(spark, d)))
