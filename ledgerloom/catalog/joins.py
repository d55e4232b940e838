"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import PRODUCT_EVENTS_SQL, product_events
from ledgerloom.operators import joins as J
from ledgerloom.operators.aggregates import entity_features, sum_by, sum_by_week


@query(f"""
WITH {PRODUCT_EVENTS_SQL}
SELECT event_id, user_session, product_id FROM e WHERE user_session IN
  (SELECT user_session FROM e WHERE event_type = 'view' AND product_id IS NOT NULL
   GROUP BY user_session HAVING count(DISTINCT product_id) > 1)
""")
def sessions_with_views(spark, d):
    """Semi-join: all events of sessions that view two or more products."""
    rows = J.sessions_with(product_events(spark, d), "user_session", "product_id", F.col("event_type") == "view")
    return rows.select("event_id", "user_session", "product_id")


@query("""
SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2
""")
def sum_by_status(spark, d):
    totals = sum_by(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice")
    return totals.withColumn("total", F.round("total", 2))


@query("""
SELECT o.o_orderkey, o.o_custkey, f.n, (((20000 * f.cents + f.n) // (2 * f.n)) + 5000) // 10000 / 100.0 AS mean_price,
  f.cents / 100.0 AS total
FROM orders o LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n, CAST(sum(round(100 * o_totalprice)) AS BIGINT) AS cents
                         FROM orders GROUP BY o_custkey) f
  ON o.o_custkey = f.o_custkey
""")
def attach_features(spark, d):
    """Count, mean and sum per customer in one pass, joined to every order.

    Prices are exact decimals here, so halves round up whatever the order of
    summation; the mean has six decimals before it is rounded to two.
    """
    price = F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", price)
    features = entity_features(
        orders, "o_custkey", {"n": "o_orderkey"}, {"mean_price": "o_totalprice"}, {"total": "o_totalprice"}
    )
    return J.attach_features(orders, features, "o_custkey").select(
        "o_orderkey", "o_custkey", "n", F.round("mean_price", 2).cast("double").alias("mean_price"), F.col("total").cast("double").alias("total")
    )


@query("""
SELECT a.o_custkey, a.n, round(b.total, 2) AS total
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a
JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b
  ON a.o_custkey = b.o_custkey
""")
def join_aggregates(spark, d):
    """Inner join of two aggregates on one key, written as one aggregation with a filter on the second."""
    is_open = F.col("o_orderstatus") == "O"
    return (
        table(spark, d, "orders").groupBy("o_custkey")
        .agg(
            F.count("*").alias("n"),
            F.round(F.sum(F.when(is_open, F.col("o_totalprice"))), 2).alias("total"),
            F.count_if(is_open).alias("_open"),
        )
        .where(F.col("_open") > 0)
        .drop("_open")
    )


def _weeks(spark, d):
    ar = table(spark, d, "orders").where(F.col("o_orderstatus") == "O")
    ap = table(spark, d, "lineitem").where(F.col("l_linestatus") == "O")
    return (
        sum_by_week(ar, "o_orderdate", "o_totalprice", "amount_ar", True),
        sum_by_week(ap, "l_shipdate", "l_extendedprice", "amount_ap", True),
        ("iso_year", "week"),
    )


def _rounded(net):
    return net.select("iso_year", "week", *[F.round(c, 2).alias(c) for c in ("amount_ar", "amount_ap", "working_capital")])


_WEEKS = """
WITH ar AS (SELECT isoyear(o_orderdate) AS iso_year, weekofyear(o_orderdate) AS week, sum(o_totalprice) AS amount_ar
            FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2),
     ap AS (SELECT isoyear(l_shipdate) AS iso_year, weekofyear(l_shipdate) AS week, sum(l_extendedprice) AS amount_ap
            FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
"""


@query(_WEEKS + """
SELECT iso_year, week, round(amount_ar, 2) AS amount_ar, round(amount_ap, 2) AS amount_ap,
       round(amount_ar - amount_ap, 2) AS working_capital FROM ar JOIN ap USING (iso_year, week)
""")
def net_by_week(spark, d):
    """Weeks that both sides have."""
    return _rounded(J.net_by_week(*_weeks(spark, d)))


@query(_WEEKS + """
SELECT iso_year, week, round(coalesce(amount_ar, 0), 2) AS amount_ar,
       round(coalesce(amount_ap, 0), 2) AS amount_ap,
       round(coalesce(amount_ar, 0) - coalesce(amount_ap, 0), 2) AS working_capital
FROM ar FULL JOIN ap USING (iso_year, week)
""")
def net_by_week_full(spark, d):
    """All weeks, a missing side counting as 0."""
    return _rounded(J.net_by_week(*_weeks(spark, d), how="full"))


@query("""
SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS big FROM customer
""")
def flag_members(spark, d):
    """True for keys that occur in another table."""
    big = table(spark, d, "orders").where(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return J.flag_members(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey", "big")
