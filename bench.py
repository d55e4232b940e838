"""Time the headline queries; prints one JSON line.

Light queries: mean of two runs after one warm-up. Queries that walk or
train: one run each, walks and training included. Results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.catalog import QUERIES, models  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

LIGHT = [
    "coview_graph", "next_in_session", "sessions_with_views", "graph_size", "payment_status_share",
    "customer_features", "vendor_features", "working_capital_by_week", "receivable_training_rows", "net_by_week",
    "corr_matrix", "moments", "quartiles", "cap_outliers", "standardize", "null_report", "flag_members",
    "dedup_first", "row_ids", "similar_items", "enrich_activity", "country_count", "activity_points",
    "stream_country_count",
]
HEAVY = ["random_walks", "item_embeddings", "churn_scores", "delay_models", "working_capital_forecast"]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in LIGHT:
        run(spark, sf_dir, name)
        times[name] = round(statistics.mean(run(spark, sf_dir, name) for _ in range(2)), 3)
    for name in HEAVY:
        models.forget()
        times[name] = round(run(spark, sf_dir, name), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
    }))


if __name__ == "__main__":
    main()
