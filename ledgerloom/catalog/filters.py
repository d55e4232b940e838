"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import PRODUCT_EVENTS_SQL, PRODUCTS_SQL, product_events, products
from ledgerloom.functions.columns import ne_or_null


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def open_invoices(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")


@query("""
SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality <> 1 OR quality IS NULL
""")
def keep_null_inequality(spark, d):
    """Inequality that keeps missing values."""
    docs = table(spark, d, "documents").select("doc_id")
    return (
        docs.join(table(spark, d, "labels"), "doc_id", "left")
        .where(ne_or_null(F.col("quality"), 1))
        .select("doc_id", "quality")
    )


@query("""
SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL
""")
def not_null(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(f"""
WITH {PRODUCT_EVENTS_SQL}
SELECT user_session, count(*) AS views FROM e WHERE event_type = 'view' GROUP BY user_session HAVING count(*) > 1
""")
def sessions_having(spark, d):
    """Filter by event type, aggregate, filter the aggregate."""
    views = product_events(spark, d).where(F.col("event_type") == "view")
    return views.groupBy("user_session").agg(F.count("*").alias("views")).where(F.col("views") > 1)


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, category_code FROM prod WHERE product_id = 42")
def product_by_key(spark, d):
    """Lookup of one key; the predicate reaches the scan."""
    return products(spark, d).where(F.col("product_id") == 42)
