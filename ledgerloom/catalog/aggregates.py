"""Aggregations and column statistics."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import (
    COVIEW_SQL,
    PAYABLES_SQL,
    RECEIVABLES_SQL,
    product_events,
    raw_payables,
    raw_receivables,
)
from ledgerloom.functions.columns import PAYMENT_STATES
from ledgerloom.operators import aggregates as A, features as L, profile as P
from ledgerloom.plans.capital import (
    SHARES,
    clean_payables,
    clean_receivables,
    customer_features as per_customer,
    vendor_features as per_vendor,
    with_delay,
)
from ledgerloom.plans.coview import coview_graph as build_graph

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_STATE = """CASE WHEN due_date - payment_date = 0 THEN 'ontime' WHEN due_date - payment_date < 0 THEN 'late'
                 WHEN due_date - payment_date > 0 THEN 'early' ELSE 'NA' END AS state"""


def _sums(prefix):
    return ", ".join(
        f"coalesce(sum(CASE WHEN state = '{s}' THEN amount END), 0) AS {prefix}{s}" for s in PAYMENT_STATES
    )


_SHARES = ", ".join(
    f"round(TA_{s} / nullif(TA_early + TA_late + TA_ontime + TA_NA, 0) * 100, 4) AS TA_{s}" for s in PAYMENT_STATES
)


def _closed(spark, d):
    return with_delay(clean_receivables(raw_receivables(spark, d)).where(F.col("is_open") == 0))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, d):
    return A.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query(f"""
WITH {RECEIVABLES_SQL}, s AS (SELECT *, {_STATE} FROM ar WHERE is_open = 0),
     p AS (SELECT customer_number, {_sums("TA_")} FROM s GROUP BY customer_number)
SELECT customer_number, {_SHARES} FROM p
""")
def payment_status_share(spark, d):
    """Amount by payment state as columns, in percent of the customer's total."""
    shares = A.row_percent(A.pivot_sum(_closed(spark, d), "customer_number", "state", "amount"), SHARES)
    return shares.select("customer_number", *[F.round(c, 4).alias(c) for c in SHARES])


@query(f"""
WITH {RECEIVABLES_SQL}, s AS (SELECT *, {_STATE} FROM ar WHERE is_open = 0),
     p AS (SELECT customer_number, count(invoice_id) AS inv_count, avg(credit_limit) AS credit_limit_mean,
                  avg(dunnlevel) AS dunnlevel_mean, sum(amount) AS amount_total, {_sums("TA_")}
           FROM s GROUP BY customer_number)
SELECT customer_number, inv_count, round(credit_limit_mean, 4) AS credit_limit_mean,
       round(dunnlevel_mean, 4) AS dunnlevel_mean, round(amount_total, 1) AS amount_total, {_SHARES} FROM p
""")
def customer_features(spark, d):
    rounded = {"credit_limit_mean": 4, "dunnlevel_mean": 4, "amount_total": 1, **{c: 4 for c in SHARES}}
    return per_customer(_closed(spark, d)).select(
        "customer_number", "inv_count", *[F.round(c, n).alias(c) for c, n in rounded.items()]
    )


@query(f"""
WITH {PAYABLES_SQL}, s AS (SELECT *, {_STATE} FROM ap WHERE status <> 'Unpaid'),
     p AS (SELECT supplier_id, count(invoice_number) AS inv_count, avg(late_fees) AS late_fees_mean,
                  avg(overdue) AS overdue_mean, sum(amount) AS amount_total, {_sums("TA_")}
           FROM s GROUP BY supplier_id)
SELECT supplier_id, inv_count, round(late_fees_mean, 4) AS late_fees_mean, round(overdue_mean, 4) AS overdue_mean,
       round(amount_total, 1) AS amount_total, {_SHARES} FROM p
""")
def vendor_features(spark, d):
    paid = with_delay(clean_payables(raw_payables(spark, d)).where(F.col("status") != "Unpaid"))
    rounded = {"late_fees_mean": 4, "overdue_mean": 4, "amount_total": 1, **{c: 4 for c in SHARES}}
    return per_vendor(paid).select(
        "supplier_id", "inv_count", *[F.round(c, n).alias(c) for c, n in rounded.items()]
    )


@query("""
SELECT isoyear(o_orderdate) AS iso_year, weekofyear(o_orderdate) AS week, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2
""")
def sum_by_week(spark, d):
    weeks = A.sum_by_week(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "total", with_year=True)
    return weeks.withColumn("total", F.round("total", 2))


@query("""
WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'doc_id' AS column_name, 'bigint' AS data_type, count(*) - count(doc_id) AS nulls FROM j
UNION ALL SELECT 'quality', 'int', count(*) - count(quality) FROM j
UNION ALL SELECT 'toxic', 'int', count(*) - count(toxic) FROM j
""")
def null_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return A.null_report(docs)


def _rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.5), 4) AS median FROM lineitem" for c in _NUMBERS
))
def medians(spark, d):
    found = P.medians(table(spark, d, "lineitem"), _NUMBERS)
    return _rows(spark, [(c, round(v, 4)) for c, v in found.items()], "column_name string, median double")


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem"
    for c in _NUMBERS
))
def quartiles(spark, d):
    """Exact quartiles, found by narrowing because the columns exceed the gather bound used here."""
    found = P.quartiles(table(spark, d, "lineitem"), _NUMBERS, gather=5_000)
    return _rows(
        spark, [(c, round(a, 4), round(b, 4)) for c, (a, b) in found.items()], "column_name string, q1 double, q3 double"
    )


@query("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, (((20000 * cents + n) // (2 * n)) + 50) // 100 / 10000.0 AS mean, deviation FROM "
    f"(SELECT CAST(sum(round(100 * {c})) AS BIGINT) AS cents, count({c}) AS n, round(stddev_pop({c}), 4) AS deviation FROM lineitem)"
    for c in _NUMBERS
))
def moments(spark, d):
    """Means of exact decimals, to six places and then to four, halves up; deviations of doubles."""
    exact = table(spark, d, "lineitem").select(*[F.col(c).cast("decimal(12,2)").alias(c) for c in _NUMBERS])
    found = P.moments(exact, _NUMBERS)
    four = Decimal("0.0001")
    return _rows(
        spark, [(c, float(m.quantize(four, ROUND_HALF_UP)), round(s, 4)) for c, (m, s) in found.items()], "column_name string, mean double, deviation double"
    )


@query("SELECT count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality <> 1) AS negative FROM labels")
def class_counts(spark, d):
    return A.class_counts(table(spark, d, "labels"), "quality")


_PAIRS = [(a, b) for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "toxic"])
          for b in ["l_quantity", "l_extendedprice", "l_discount", "toxic"][:i]]
_GAPPED = """WITH g AS (SELECT l_quantity, l_extendedprice, l_discount, toxic
                   FROM lineitem LEFT JOIN labels ON l_partkey = doc_id)
"""


@query(_GAPPED + "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM g" for a, b in _PAIRS
))
def corr_matrix(spark, d):
    """Correlations, one column having gaps."""
    lines, labels = table(spark, d, "lineitem"), table(spark, d, "labels")
    gapped = lines.join(labels, lines.l_partkey == labels.doc_id, "left")
    found = P.corr_matrix(gapped, ["l_quantity", "l_extendedprice", "l_discount", "toxic"])
    return found.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


_GAPPED_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "toxic", "packed"]


@query(_GAPPED.replace("l_discount, toxic", "l_discount, toxic, 1.2 * l_quantity + l_linenumber AS packed") + "SELECT col_a FROM (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, corr({a}, {b}) AS c FROM g" for i, a in enumerate(_GAPPED_NUMBERS) for b in _GAPPED_NUMBERS[:i]
) + ") WHERE abs(c) > 0.8 GROUP BY col_a")
def correlated_columns(spark, d):
    """Later columns of pairs correlated above 0.8, the ones a training run drops; ``packed`` repeats the quantity."""
    lines, labels = table(spark, d, "lineitem"), table(spark, d, "labels")
    lines = lines.withColumn("packed", 1.2 * F.col("l_quantity") + F.col("l_linenumber"))
    gapped = lines.join(labels, lines.l_partkey == labels.doc_id, "left")
    return _rows(spark, [(c,) for c in P.correlated_columns(gapped, _GAPPED_NUMBERS)], "col_a string")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'N'")
def uncorrelated_rows(spark, d):
    """Columns are chosen on settled lines alone; open lines lose the same ones."""
    lines = table(spark, d, "lineitem").withColumn("packed", 1.2 * F.col("l_quantity") + F.col("l_linenumber"))
    settled, open_ = lines.where("l_returnflag <> 'N'"), lines.where("l_returnflag = 'N'")
    dropped = P.correlated_columns(settled, ["l_quantity", "l_discount", "packed"])
    kept = [c for c in ("l_quantity", "l_discount", "packed") if c not in dropped]
    return open_.select("l_orderkey", "l_linenumber", *kept)


@query(f"""
WITH {COVIEW_SQL}
SELECT (SELECT count(*) FROM (SELECT pid_1 FROM edges UNION SELECT pid_2 FROM edges)) AS nodes,
       (SELECT count(*) FROM edges) AS edges
""")
def graph_size(spark, d):
    return P.graph_size(build_graph(product_events(spark, d)))


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(greatest(least(l_extendedprice, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)), 4) AS l_extendedprice
FROM lineitem, q
""")
def cap_outliers(spark, d):
    """Values bounded at half an interquartile range outside the quartiles."""
    capped = L.cap_outliers(table(spark, d, "lineitem").select(*_KEYS, "l_extendedprice"), ["l_extendedprice"], 0.5)
    return capped.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("""
WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - a) / s, 6) AS l_extendedprice
FROM lineitem, m
""")
def standardize(spark, d):
    scaled = L.standardize(table(spark, d, "lineitem").select(*_KEYS, "l_extendedprice"), ["l_extendedprice"])
    return scaled.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("""
WITH j AS (SELECT d.doc_id, CAST(quality * n_chars AS DOUBLE) AS x FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
     m AS (SELECT quantile_cont(x, 0.5) AS med FROM j)
SELECT doc_id, coalesce(x, med) AS x FROM j, m
""")
def impute_median(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return L.impute_median(docs.select("doc_id", (F.col("quality") * F.col("n_chars")).cast("double").alias("x")), ["x"])
