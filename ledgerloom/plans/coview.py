"""Session co-view graph: which products follow each other within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.functions.columns import canonical_edge, parse_event_time
from ledgerloom.operators.sequence import (
    HOT_ROWS,
    lead_in_group,
    lead_in_hot_groups,
    pieces_for,
    split_hot,
)
from ledgerloom.session import materialize

NO_NEXT = -1


def edges_of(pairs: DataFrame, a: str = "product_id", b: str = "next_product_id") -> DataFrame:
    """Weighted undirected edges of consecutive pairs: no session ends, gaps or repeats."""
    pid_1, pid_2 = canonical_edge(F.col(a), F.col(b))
    return (
        pairs.where((F.col(b) != NO_NEXT) & F.col(a).isNotNull() & (F.col(a) != F.col(b)))
        .groupBy(pid_1.alias("pid_1"), pid_2.alias("pid_2"))
        .agg(F.count("*").alias("occurrence_ct"))
    )


def event_order(events: DataFrame) -> list[str]:
    """Event time, then the event id; without ids all other columns, so that only equal events tie."""
    if "event_id" in events.columns:
        return ["event_time", "event_id"]
    return ["event_time", *(c for c in events.columns if c not in ("event_time", "user_session"))]


def coview_graph(events: DataFrame, order: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(pid_1, pid_2, occurrence_ct) from events of sessions that view two or more products.

    ``events`` has the columns of ``schemas.PRODUCT_EVENTS``; a text time loses
    its zone suffix. An ``event_id`` is optional and settles equal times.

    All event types of such a session stay in its sequence; only the test for
    two products looks at views. One shuffle on the session serves both the
    test and the lead. Sessions above ``hot_rows`` are cut into ranges.
    """
    if "event_time" in events.columns and events.schema["event_time"].dataType.typeName() == "string":
        events = events.withColumn("event_time", parse_event_time(F.col("event_time")))
    order = order or event_order(events)
    rows = events.where(F.col("user_session").isNotNull()).select(
        *dict.fromkeys(["user_session", "product_id", *order]),
        F.when(F.col("event_type") == "view", F.col("product_id")).alias("_viewed"),
    )
    lo, hi = F.min("_viewed"), F.max("_viewed")
    hot = rows.groupBy("user_session").agg(
        F.count("*").alias("_n"), lo.alias("_lo"), hi.alias("_hi")
    ).where(F.col("_n") > hot_rows)

    def sequence(cold: DataFrame) -> DataFrame:
        session = Window.partitionBy("user_session")
        led = lead_in_group(cold, "user_session", order, "product_id", NO_NEXT, "next_product_id")
        return (
            led.withColumns({"_lo": lo.over(session), "_hi": hi.over(session)})
            .where(F.col("_lo") != F.col("_hi"))
            .select("product_id", "next_product_id")
        )

    if rows.count() <= hot_rows:
        return edges_of(sequence(rows))
    hot = materialize(hot, "hot-sessions")
    if hot.isEmpty():
        return edges_of(sequence(rows))
    cold, _ = split_hot(rows, "user_session", hot)
    viewing = hot.where(F.col("_lo") != F.col("_hi"))
    large = rows.join(viewing.select("user_session"), "user_session", "left_semi")
    led = lead_in_hot_groups(
        large, "user_session", order, "product_id", NO_NEXT, "next_product_id",
        pieces_for(hot, "_n", hot_rows),
    )
    return edges_of(sequence(cold).unionByName(led.select("product_id", "next_product_id")))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoint ids."""
    return edges.select(F.col("pid_1").alias("node")).union(edges.select("pid_2")).distinct()
