"""Projections, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.functions import columns as C, frames as T
from ledgerloom.operators.aggregates import null_report as report_nulls


@query("SELECT n_nationkey, n_name, 'country' AS country_l, 'state' AS state_l FROM nation")
def constant_columns(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return nation.withColumns({"country_l": F.lit("country"), "state_l": F.lit("state")})


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def key_first_drop(spark, d):
    """Columns dropped, key moved to the front."""
    orders = table(spark, d, "orders").drop("o_orderstatus", "o_orderdate", "o_orderpriority")
    return T.key_first(orders, "o_custkey")


@query("SELECT o_orderkey AS invoice_id, o_custkey AS customer_number, o_totalprice AS amount FROM orders")
def rename_columns(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return T.rename(orders, {"o_orderkey": "invoice_id", "o_custkey": "customer_number", "o_totalprice": "amount"})


@query("""
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
       CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders
""")
def cast_columns(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_totalprice").alias("whole")
    )
    return T.cast_columns(orders, {"level": "int", "whole": "bigint"})


@query("SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS FLOAT) AS c_acctbal, c_mktsegment FROM customer")
def cast_by_type(spark, d):
    """All doubles to float; ids keep their type."""
    return T.cast_by_type(table(spark, d, "customer"), {"double": "float"}, keep=("c_custkey",))


@query("""
SELECT c.column_name, CASE WHEN c.column_name IN ('o_orderstatus', 'o_orderdate', 'o_orderpriority')
         THEN 'categorical' ELSE 'numeric' END AS role, count(*) AS filled
FROM orders CROSS JOIN (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate',
                                       'o_orderpriority']) AS column_name) c
GROUP BY c.column_name
""")
def column_roles(spark, d):
    """Categorical and numeric columns by type, with the number of filled rows."""
    orders = table(spark, d, "orders")
    cat, _ = T.split_by_type(orders)
    rows = orders.count()
    return report_nulls(orders).select(
        "column_name",
        F.when(F.col("column_name").isin(cat), "categorical").otherwise("numeric").alias("role"),
        (F.lit(rows) - F.col("nulls")).alias("filled"),
    )


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def numeric_only(spark, d):
    return T.numeric_only(table(spark, d, "supplier"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def event_time(spark, d):
    """Time from text with a zone suffix."""
    text = F.concat(F.col("ts").cast("string"), F.lit(" UTC"))
    events = table(spark, d, "events").select("event_id", C.parse_event_time(text).alias("t"))
    return events.select("event_id", F.unix_micros(F.col("t").cast("timestamp")).alias("micros"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def us_dates(spark, d):
    text = F.date_format("o_orderdate", "M/d/yyyy")
    return table(spark, d, "orders").select("o_orderkey", C.parse_us_date(text).cast("string").alias("day"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders
""")
def any_dates(spark, d):
    """Dates written in several formats; text that is no date is NULL."""
    kind, day = F.pmod("o_orderkey", F.lit(4)), F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "M/d/yyyy"))
        .when(kind == 2, F.date_format(day, "d-MMM-yyyy"))
        .otherwise("soon")
    )
    return table(spark, d, "orders").select("o_orderkey", C.parse_any_date(text).cast("string").alias("day"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days,
       CAST(CAST(l_shipdate AS DATE) + CAST(floor(l_discount * 40 - l_linenumber / 2.0) AS INTEGER) AS VARCHAR) AS moved
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def day_arithmetic(spark, d):
    """Whole days between dates; dates moved by fractional days."""
    lines = table(spark, d, "lineitem").join(
        table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    fraction = F.col("l_discount") * 40 - F.col("l_linenumber") / 2.0
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.datediff("l_shipdate", "o_orderdate").alias("days"),
        C.add_days(F.to_date("l_shipdate"), fraction).cast("string").alias("moved"),
    )


@query("""
SELECT isoyear(o_orderdate) AS iso_year, weekofyear(o_orderdate) AS week, count(*) AS orders FROM orders GROUP BY 1, 2
""")
def iso_weeks(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(
        C.iso_year(day).alias("iso_year"), C.week_of(day).alias("week")
    ).agg(F.count("*").alias("orders"))


@query("""
SELECT o_orderkey, CAST(round_even(CAST(o_totalprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS rounded FROM orders
""")
def round_half_even(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.round_half_even(F.col("o_totalprice")).alias("rounded"))


@query("""
SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def fill_nulls(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").na.fill(0, ["quality", "toxic"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio FROM lineitem
""")
def safe_ratio(spark, d):
    """A zero denominator gives NULL."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(C.safe_ratio(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("ratio"),
    )


@query("""
SELECT c_custkey, c_mktsegment AS segment, 'right' AS shared, CAST(c_nationkey AS VARCHAR) AS nation, 3 AS tags
FROM customer
""")
def merged_tags(spark, d):
    """Maps from columns, united; the right side wins on a shared key."""
    left = F.map_concat(C.single_tag("segment", F.col("c_mktsegment")), C.single_tag("shared", F.lit("left")))
    right = F.map_concat(C.tags_map("c_nationkey"), C.single_tag("shared", F.lit("right")))
    both = table(spark, d, "customer").select("c_custkey", C.merge_tags(left, right).alias("t"))
    return both.select(
        "c_custkey", F.col("t")["segment"].alias("segment"), F.col("t")["shared"].alias("shared"),
        F.col("t")["c_nationkey"].alias("nation"), F.size("t").alias("tags"),
    )


@query("""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)
SELECT page_id, split_part(host, '.', 1) AS "L1", nullif(split_part(host, '.', 2), '') AS "L2",
       nullif(split_part(host, '.', 3), '') AS "L3" FROM h
""")
def category_levels(spark, d):
    """Dotted text to three levels."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return table(spark, d, "pages").select("page_id", *C.category_levels(host))


@query("SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS bounded FROM customer")
def clipped(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("bounded"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS token, p_partkey AS back FROM part")
def id_tokens(spark, d):
    """Ids to text tokens and back."""
    token = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", token.alias("token"), token.cast("bigint").alias("back"))


@query("""
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_BUILDING,
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_HOUSEHOLD, CAST(c_mktsegment = 'UNUSED' AS INTEGER) AS seg_UNUSED
FROM customer
""")
def one_hot(spark, d):
    """A column per declared level, also for one the data lacks."""
    return table(spark, d, "customer").select(
        "c_custkey", *C.one_hot("c_mktsegment", ["BUILDING", "HOUSEHOLD", "UNUSED"], "seg")
    )


@query("""
SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS status_O, CAST(o_orderstatus = 'P' AS INTEGER) AS status_P
FROM orders
""")
def one_hot_drop_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *C.one_hot("o_orderstatus", "OPF", "status", drop_first=True))
