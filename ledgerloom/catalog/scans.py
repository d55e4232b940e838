"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import COVIEW_SQL, product_events
from ledgerloom.functions.frames import preview
from ledgerloom.plans.coview import coview_graph as build_graph
from ledgerloom.session import scratch_path
from ledgerloom.sinks.writers import write_csv, write_edge_list, write_table
from ledgerloom.sources.readers import read_edge_list, read_since, read_table, rows_to_df


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_scan(spark, d):
    """Table written as CSV with header and read with its schema."""
    supplier = table(spark, d, "supplier")
    path = scratch_path(spark, "supplier") + ".csv"
    write_csv(supplier, path)
    return read_table(spark, path, supplier.schema)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan_inferred(spark, d):
    """The same with inferred types."""
    path = scratch_path(spark, "customer") + ".csv"
    write_csv(table(spark, d, "customer"), path)
    return read_table(spark, path)


@query("""
SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity < 10
""")
def parquet_scan(spark, d):
    """Scan by path inside SQL text; filter and columns reach the file."""
    return spark.sql(
        f"SELECT l_orderkey, l_suppkey, l_quantity FROM parquet.`{d}/lineitem.parquet` "
        "WHERE l_shipdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00' AND l_quantity < 10"
    )


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def read_since_mark(spark, d):
    """Incremental read: rows later than the last mark."""
    return read_since(table(spark, d, "events"), "ts", "2024-01-20 00:00:00").select("event_id", "user_id", "value")


@query("""
SELECT s.meaning, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN (VALUES ('O', 'open'), ('F', 'finished'), ('P', 'partly')) AS s(code, meaning)
  ON o_orderstatus = s.code GROUP BY s.meaning
""")
def rows_lookup(spark, d):
    """Program rows as a lookup table."""
    names = rows_to_df(spark, [("O", "open"), ("F", "finished"), ("P", "partly")], "code string, meaning string")
    orders = table(spark, d, "orders")
    return (
        orders.join(F.broadcast(names), orders.o_orderstatus == names.code)
        .groupBy("meaning")
        .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def table_round_trip(spark, d):
    """Parquet table written by partition and read back."""
    path = scratch_path(spark, "orders")
    write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
                path, ["o_orderstatus"])
    return read_table(spark, path)


@query(f"WITH {COVIEW_SQL} SELECT pid_1, pid_2, occurrence_ct FROM edges")
def edge_list_round_trip(spark, d):
    """Edges as tab-separated text and back."""
    path = scratch_path(spark, "edges")
    write_edge_list(build_graph(product_events(spark, d)), path)
    return read_edge_list(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_rows(spark, d):
    return preview(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 5, ["o_orderkey"])
