"""Data products that SQL can state in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import (
    COVIEW_SQL,
    PAYABLES_SQL,
    PRODUCTS_SQL,
    RECEIVABLES_SQL,
    product_events,
    products,
    raw_payables,
    raw_receivables,
)
from ledgerloom.operators.aggregates import sum_by_week
from ledgerloom.operators.embeddings import similar_items as find_similar
from ledgerloom.operators.joins import net_by_week
from ledgerloom.plans import capital, coview, recommend as R


@query(f"WITH {COVIEW_SQL} SELECT pid_1, pid_2, occurrence_ct FROM edges")
def coview_graph(spark, d):
    return coview.coview_graph(product_events(spark, d))


@query(f"WITH {COVIEW_SQL} SELECT pid_1, pid_2, occurrence_ct FROM edges")
def coview_graph_large_sessions(spark, d):
    """The same graph with sessions above a few events cut into ranges."""
    return coview.coview_graph(product_events(spark, d), hot_rows=8)


@query(f"""
WITH {RECEIVABLES_SQL}, {PAYABLES_SQL},
     a AS (SELECT weekofyear(due_date) AS week, sum(amount) AS amount_ar FROM ar WHERE is_open = 1 GROUP BY 1),
     b AS (SELECT weekofyear(due_date) AS week, sum(amount) AS amount_ap FROM ap WHERE status = 'Unpaid' GROUP BY 1)
SELECT a.week, round(amount_ar, 1) AS amount_ar, round(amount_ap, 1) AS amount_ap,
       round(amount_ar - amount_ap, 1) AS working_capital FROM a JOIN b ON a.week = b.week
""")
def working_capital_by_week(spark, d):
    """Net amount by the week invoices are due."""
    ar = capital.clean_receivables(raw_receivables(spark, d)).where(F.col("is_open") == 1)
    ap = capital.clean_payables(raw_payables(spark, d)).where(F.col("status") == "Unpaid")
    net = net_by_week(
        sum_by_week(ar, "due_date", "amount", "amount_ar"), sum_by_week(ap, "due_date", "amount", "amount_ap")
    )
    return net.select("week", *[F.round(c, 1).alias(c) for c in ("amount_ar", "amount_ap", "working_capital")])


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"""
WITH {RECEIVABLES_SQL}, s AS (SELECT * FROM ar WHERE is_open = 0),
     f AS (SELECT customer_number, count(invoice_id) AS inv_count, avg(credit_limit) AS credit_limit_mean
           FROM s GROUP BY customer_number)
SELECT s.invoice_id, s.amount, s.payterm, s.credit_limit, round(f.credit_limit_mean, 4) AS credit_limit_mean, f.inv_count,
       CAST(s.due_date - s.payment_date AS INTEGER) AS delay, CAST(s.posting_date - s.baseline_date AS INTEGER) AS diff_pb,
       {", ".join(f"CAST(region = '{r}' AS INTEGER) AS {r.replace(' ', '_')}" for r in _REGIONS)}
FROM s LEFT JOIN f ON s.customer_number = f.customer_number
""")
def receivable_training_rows(spark, d):
    """Closed invoices with the columns the delay model is trained on."""
    rows = capital.receivable_rows(capital.clean_receivables(raw_receivables(spark, d)), 0, _REGIONS)
    return rows.select(
        "invoice_id", "amount", "payterm", "credit_limit", F.round("credit_limit_mean", 4).alias("credit_limit_mean"),
        "inv_count", "delay", "diff_pb", *[F.col(r).alias(r.replace(" ", "_")) for r in _REGIONS],
    )


_CATEGORIES = ["Fees", "Raw Material", "Services", "Taxes", "Utility"]


@query(f"""
WITH {PAYABLES_SQL}, s AS (SELECT * FROM ap WHERE status <> 'Unpaid' OR status IS NULL),
     f AS (SELECT supplier_id, count(invoice_number) AS inv_count, avg(late_fees) AS late_fees_mean, avg(overdue) AS overdue_mean
           FROM s GROUP BY supplier_id)
SELECT s.invoice_number, s.amount, s.payterm_n, f.inv_count, round(f.late_fees_mean, 4) AS late_fees_mean,
       round(f.overdue_mean, 4) AS overdue_mean, CAST(s.due_date - s.payment_date AS INTEGER) AS delay,
       CAST(s.posting_date - s.invoice_date AS INTEGER) AS diff_pb,
       {", ".join(f"CAST(spend_category = '{c}' AS INTEGER) AS {c.replace(' ', '_')}" for c in _CATEGORIES)},
       CAST(vendor_type = 'Domestic' AS INTEGER) AS domestic
FROM s LEFT JOIN f ON s.supplier_id = f.supplier_id
""")
def payable_training_rows(spark, d):
    """Paid invoices with the columns the delay model is trained on."""
    rows = capital.payable_rows(capital.clean_payables(raw_payables(spark, d)), unpaid=False)
    return rows.select(
        "invoice_number", "amount", "payterm_n", "inv_count", F.round("late_fees_mean", 4).alias("late_fees_mean"),
        F.round("overdue_mean", 4).alias("overdue_mean"), "delay", "diff_pb",
        *[F.col(f"`Spend Category_{c}`").alias(c.replace(" ", "_")) for c in _CATEGORIES],
        F.col("Vendor_Type_Domestic").alias("domestic"),
    )


def _given_embeddings(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pid"), F.col("embedding").alias("embedding_vector")
    )


def _similar_sql(k):
    # The full cosine ranks; the smaller id wins a tie.
    return f"""
u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS pid, b.vec_id AS "similar", list_cosine_similarity(a.v, b.v) AS full_cosine
      FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, round(full_cosine, 6) AS cosine, row_number() OVER (PARTITION BY pid ORDER BY full_cosine DESC, "similar") AS rank FROM s
      QUALIFY rank <= {k})
"""


@query(f'WITH {_similar_sql(3)} SELECT pid, "similar", cosine, rank FROM r')
def similar_items(spark, d):
    """Three most similar vectors of every vector, by cosine."""
    return find_similar(_given_embeddings(spark, d), k=3)


@query(f'WITH {_similar_sql(3)} SELECT pid, "similar", cosine, rank FROM r')
def similar_items_by_cells(spark, d):
    """The same by the way that serves many vectors."""
    return find_similar(_given_embeddings(spark, d), k=3, small_rows=10, group_rows=100)


@query(f"""
WITH {PRODUCTS_SQL}, {_similar_sql(1)}
SELECT pid AS product_id, CAST("similar" AS VARCHAR) AS prod_id, category_code, rank
FROM r LEFT JOIN prod ON "similar" = product_id
""")
def recommend_given(spark, d):
    """Most similar product and its category, from the embeddings table."""
    return R.recommend(_given_embeddings(spark, d), products(spark, d))


@query("""
SELECT product_id, min(category_code) AS category_code FROM
  (SELECT p_size AS product_id, concat(p_type, '.', p_brand) AS category_code FROM part) GROUP BY product_id
""")
def first_categories(spark, d):
    """One category per product out of many rows."""
    rows = table(spark, d, "part").select(
        F.col("p_size").alias("product_id"), F.concat_ws(".", "p_type", "p_brand").alias("category_code")
    )
    return R.first_categories(rows)
