"""The test tables seen as the inputs of the data products, in Spark and in SQL.

The SQL texts are common table expressions for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.catalog.registry import table
from ledgerloom.functions.columns import single_tag

# --- product events ---------------------------------------------------------

PRODUCT_EVENTS_SQL = """
e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS product_id,
             ts AS event_time, event_type,
             concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS user_session
      FROM events)
"""

COVIEW_SQL = PRODUCT_EVENTS_SQL + """,
v AS (SELECT * FROM e WHERE user_session IN
        (SELECT user_session FROM e
         WHERE event_type = 'view' AND user_session IS NOT NULL AND product_id IS NOT NULL
         GROUP BY user_session HAVING count(DISTINCT product_id) > 1)),
g AS (SELECT product_id, lead(product_id, 1, -1) OVER
        (PARTITION BY user_session ORDER BY event_time, event_id) AS nxt FROM v),
edges AS (SELECT greatest(product_id, nxt) AS pid_1, least(product_id, nxt) AS pid_2,
                 count(*) AS occurrence_ct
          FROM g WHERE nxt <> -1 AND product_id IS NOT NULL AND product_id <> nxt
          GROUP BY 1, 2)
"""


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks by user and day; the product is the ``k`` of the properties."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        F.col("ts").alias("event_time"),
        "event_type",
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("user_session"),
    )


PRODUCTS_SQL = """
prod AS (SELECT p_partkey AS product_id, concat(p_type, '.', replace(p_name, ' ', '.')) AS category_code
         FROM part)
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product ids with a dotted category made of type and name words."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.col("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("category_code"),
    )


# --- activity stream --------------------------------------------------------

def activity(events: DataFrame) -> DataFrame:
    """Events in the shape of the activity records; works on a stream as well."""
    return events.select(
        F.col("user_id").cast("int").alias("id"),
        F.pmod("event_id", F.lit(20)).cast("int").alias("campaignid"),
        F.col("event_id").cast("int").alias("orderid"),
        F.floor("value").cast("int").alias("total_amount"),
        F.get_json_object("props", "$.k").cast("int").alias("units"),
        single_tag("activity", F.col("event_type")).alias("tags"),
    )


ACTIVITY_SQL = """
act AS (SELECT CAST(user_id AS INTEGER) AS id, CAST(event_id % 20 AS INTEGER) AS campaignid,
               CAST(event_id AS INTEGER) AS orderid, CAST(floor(value) AS INTEGER) AS total_amount,
               CAST(json_extract(props, '$.k') AS INTEGER) AS units, event_type AS activity
        FROM events)
"""

DEMOGRAPHICS_SQL = """
demo AS (SELECT CAST(c_custkey AS INTEGER) AS i, CAST(c_custkey % 60 AS INTEGER) AS age,
                CASE WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender,
                c_mktsegment AS state, n_name AS country
         FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the demographic dimension, one row per user id."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("int").alias("i"),
        F.pmod("c_custkey", F.lit(60)).cast("int").alias("age"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, "MALE").otherwise("FEMALE").alias("gender"),
        F.col("c_mktsegment").alias("state"),
        F.col("n_name").alias("country"),
    )


# --- receivables and payables ----------------------------------------------

RECEIVABLES_SQL = """
paid AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS paid, CAST(min(l_shipdate) AS DATE) AS first_ship
         FROM lineitem GROUP BY l_orderkey),
ar AS (SELECT o_orderkey AS invoice_id, o_custkey AS customer_number,
              CAST(round_even(CAST(o_totalprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS amount,
              CAST(o_orderdate AS DATE) AS posting_date, CAST(o_orderdate AS DATE) + 60 AS due_date,
              coalesce(first_ship, CAST(o_orderdate AS DATE)) AS baseline_date,
              CASE WHEN o_orderstatus <> 'O' THEN paid END AS payment_date,
              CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open,
              60 AS payterm, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS dunnlevel,
              CAST(trunc(c_acctbal) AS INTEGER) AS credit_limit, r_name AS region
       FROM orders LEFT JOIN paid ON o_orderkey = l_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)
"""


def raw_receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receivable invoices with the original column names and text dates."""
    ships = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("paid"), F.min("l_shipdate").alias("first_ship")
    )
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders")
    joined = (
        orders.join(ships, orders.o_orderkey == ships.l_orderkey, "left")
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )

    def us(c):
        return F.date_format(c, "MM/dd/yyyy")

    return joined.select(
        F.col("o_custkey").alias("Customer Number"),
        F.col("o_orderkey").alias("Invoice ID"),
        us(F.col("o_orderdate")).alias("Posting_Date"),
        us(F.date_add(F.to_date("o_orderdate"), 60)).alias("Due_Date"),
        us(F.coalesce("first_ship", "o_orderdate")).alias("Baseline_Date"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(us(F.col("paid"))).alias("Payment_Date"),
        F.col("o_totalprice").alias("Total Open Amount_USD"),
        F.lit("60").alias("Payterm"),
        F.substring("o_orderpriority", 1, 1).alias("DUNNLEVEL"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("Is Open"),
        F.col("c_acctbal").alias("Credit_limit"),
        F.col("r_name").alias("Region"),
    )


PAYABLES_SQL = """
ap AS (SELECT l_suppkey AS supplier_id, l_orderkey * 10 + l_linenumber AS invoice_number,
              CASE WHEN l_linestatus = 'O' THEN 'Unpaid' ELSE 'Paid' END AS status,
              CAST(l_shipdate AS DATE) AS posting_date, CAST(l_shipdate AS DATE) + 30 AS due_date,
              CAST(l_shipdate AS DATE) - CAST(l_quantity AS INTEGER) AS invoice_date,
              CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) + 30
                + CAST(round(l_discount * 100) AS INTEGER) - l_linenumber END AS payment_date,
              CAST(round_even(CAST(l_extendedprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS amount,
              CAST(round_even(CAST(l_quantity AS DECIMAL(18, 2)), 1) AS DOUBLE) AS overdue,
              CAST(round_even(CAST(l_quantity * 2 AS DECIMAL(18, 2)), 1) AS DOUBLE) AS late_fees,
              30 AS payterm_n,
              ['Fees', 'Raw Material', 'Services', 'Taxes', 'Utility'][(l_partkey % 5) + 1] AS spend_category,
              CASE WHEN l_suppkey % 2 = 0 THEN 'Domestic' ELSE 'International' END AS vendor_type
       FROM lineitem)
"""


def raw_payables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payable invoices with the original column names and text dates."""
    ship = F.to_date("l_shipdate")
    categories = F.array(*[F.lit(v) for v in ("Fees", "Raw Material", "Services", "Taxes", "Utility")])
    unpaid = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("Supplier ID"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Invoice Number"),
        F.when(unpaid, "Unpaid").otherwise("Paid").alias("Invoice Status"),
        ship.cast("string").alias("Posting Date"),
        F.date_add(ship, 30).cast("string").alias("Net Due Date (System Calculated Date)"),
        F.date_sub(ship, F.col("l_quantity").cast("int")).cast("string").alias("Invoice Date"),
        F.when(
            ~unpaid,
            F.date_add(ship, F.lit(30) + F.round(F.col("l_discount") * 100).cast("int") - F.col("l_linenumber")),
        ).cast("string").alias("Payment Date"),
        F.col("l_extendedprice").alias("Invoice Amount"),
        F.col("l_quantity").alias("Overdue"),
        F.col("l_extendedprice").alias("Total Outstanding amount"),
        (F.col("l_quantity") * 2).alias("Late payment fees"),
        F.lit("30").alias("Payterm_n"),
        F.get(categories, F.pmod("l_partkey", F.lit(5)).cast("int")).alias("Spend Category"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "Domestic").otherwise("International").alias("Vendor_Type"),
    )


# --- churn customers --------------------------------------------------------

CHURN_SQL = """
recent AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) * 0.01 AS cashback, max(o_orderdate) AS last_order
           FROM orders GROUP BY o_custkey),
churners AS (SELECT c_custkey AS "CustomerID",
                    CASE WHEN last_order >= TIMESTAMP '2000-08-01' THEN 0 ELSE 1 END AS "Churn",
                    CAST(c_nationkey % 3 + 1 AS INTEGER) AS "CityTier", cashback AS "CashbackAmount",
                    CAST(n AS DOUBLE) AS "OrderCount", c_acctbal AS "Balance", c_mktsegment AS "Segment"
             FROM customer LEFT JOIN recent ON c_custkey = o_custkey)
"""


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with order features; churned when nothing was ordered in the last year of the data."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("OrderCount"),
        (F.avg("o_totalprice") * 0.01).alias("CashbackAmount"),
        F.max("o_orderdate").alias("last_order"),
    )
    customer = table(spark, sf_dir, "customer")
    active = F.col("last_order") >= F.lit("2000-08-01").cast("timestamp_ntz")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left").select(
        F.col("c_custkey").alias("CustomerID"),
        F.when(active, 0).otherwise(1).alias("Churn"),
        (F.pmod("c_nationkey", F.lit(3)) + 1).cast("int").alias("CityTier"),
        "CashbackAmount",
        "OrderCount",
        F.col("c_acctbal").alias("Balance"),
        F.col("c_mktsegment").alias("Segment"),
    )
