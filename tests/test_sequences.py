"""Sequences, the co-view graph, and the ways for large groups."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sequence as S
from ledgerloom.plans.coview import coview_graph

SCHEMA = "user_session string, event_time int, event_id int, event_type string, product_id bigint"


def events(spark, *sessions):
    rows = []
    for n, items in enumerate(sessions):
        for t, item in enumerate(items):
            kind, product = item if isinstance(item, tuple) else ("view", item)
            rows.append((f"s{n}", t, len(rows), kind, product))
    return spark.createDataFrame(rows, SCHEMA)


def edges(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot_rows", [10_000, 1])
@pytest.mark.parametrize(
    "session, want",
    [
        ([5, 9, 5], [(9, 5, 2)]),
        ([5, 5, 9], [(9, 5, 1)]),
        ([5, 5], []),
        ([1, 2, ("cart", 3)], [(2, 1, 1), (3, 2, 1)]),
        ([5, None, 9, 7], [(9, 7, 1)]),
        ([("cart", 1), ("cart", 2)], []),
    ],
)
def test_coview_cases(spark, session, want, hot_rows):
    assert edges(coview_graph(events(spark, session), hot_rows=hot_rows)) == want


def test_null_session_is_left_out(spark):
    df = events(spark, [1, 2]).withColumn("user_session", F.lit(None).cast("string"))
    assert edges(coview_graph(df)) == []


def test_large_sessions_equal_plain(spark):
    rng = random.Random(3)
    sessions = [[rng.randrange(9) for _ in range(n)] for n in (400, 3, 250, 1, 7)]
    df = events(spark, *sessions)
    plain, cut = coview_graph(df), coview_graph(df, hot_rows=40)
    assert edges(plain) == edges(cut)
    assert all(a > b for a, b, _ in edges(plain))


def test_next_keeps_null_and_default(spark):
    df = events(spark, [5, None, 9])
    for hot_rows in (100, 1):
        got = S.next_in_session(df, "user_session", ["event_time", "event_id"], "product_id", hot_rows=hot_rows)
        assert [r.next_value for r in got.orderBy("event_id").collect()] == [None, 9, -1]


def test_tied_times_in_one_large_session(spark):
    df = spark.range(500).select(
        F.lit("s").alias("user_session"), F.lit(1).alias("event_time"), F.col("id").alias("event_id"), F.col("id").alias("v")
    )
    got = S.next_in_session(df, "user_session", ["event_time", "event_id"], "v", hot_rows=20)
    assert {(r.v, r.next_value) for r in got.collect()} == {(i, i + 1 if i < 499 else -1) for i in range(500)}


def test_row_ids_and_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("n")).repartition(5)
    assert {(r.ID, r.k) for r in S.with_row_id(df, ["k"]).collect()} == {(i + 1, i) for i in range(1000)}
    assert {(r.k, r.s) for r in S.running_total(df, ["k"], "n", "s").collect()} == {(i, 2 * i + 2) for i in range(1000)}


def test_dedup_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, None), (2, 1, "x")], "k int, o int, v string")
    assert {tuple(r) for r in S.dedup_first(df, "k", ["o"]).collect()} == {(1, 2, None), (2, 1, "x")}


def test_ranges_are_bounded_in_number(spark):
    """A small ``hot_rows`` over many rows must not make a task of every few hundred rows."""
    def pieces(rows, hot_rows):
        return S.pieces_for(spark.createDataFrame([(rows,)], "_n bigint"), "_n", hot_rows)

    assert pieces(1_000, 100) == 20 and pieces(10, 100) == 2
    assert pieces(36_000_000, 500) == S.PIECES
    assert pieces(10**10, 500) == 10_000  # two million rows a range at most
