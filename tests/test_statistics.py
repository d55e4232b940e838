"""Exact quantiles, correlations, joins, shares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import QUERIES
from ledgerloom.operators import aggregates as A, features as L, joins as J, profile as P


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("gather", [10, 100_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "one", "ends", "steps"])
def test_quantiles_are_exact(spark, gather, kind):
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=2001),
        "ties": np.where(rng.random(3000) < 0.7, 4.0, rng.normal(size=3000)),
        "one": np.full(500, 2.5),
        "ends": np.concatenate([np.zeros(900), np.arange(1, 101), np.full(1000, 500.0)]),
        "steps": rng.integers(0, 5, 4000).astype(float),
    }[kind]
    probs = [0.0, 0.25, 0.333, 0.5, 0.75, 1.0]
    df = column(spark, [None, *values]).repartition(3)
    got = P.exact_quantiles(df, ["x"], probs, gather=gather)["x"]
    assert np.allclose(got, np.quantile(values, probs), rtol=0, atol=1e-12)


def test_quartiles_small_and_empty(spark):
    assert P.quartiles(column(spark, [1, 2, 3, 4]), ["x"])["x"] == [1.75, 3.25]
    assert P.medians(column(spark, [None]), ["x"])["x"] is None


def test_correlation_with_gaps_and_constant(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    data["d"] = data.a * 2 + 0.1 * data.b
    data["e"] = 1.0
    data.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()],
                               ", ".join(f"{c} double" for c in data))
    got = {(r.col_a, r.col_b): r["corr"] for r in P.corr_matrix(df, list("abcde")).collect()}
    want = data.corr()
    for (a, b), v in got.items():
        assert v is None if "e" in (a, b) else abs(v - want.loc[a, b]) < 1e-12
    assert P.correlated_columns(df, list("abcde")) == ["d"]
    assert L.drop_correlated(df, list("abcde")).columns == list("abce")


def test_shares(spark):
    df = spark.createDataFrame([("a", 30.0, 10.0, 0.0), ("b", 0.0, 0.0, 0.0)], "k string, e double, l double, o double")
    got = {r.k: tuple(r)[1:] for r in A.row_percent(df, ["e", "l", "o"]).collect()}
    assert got == {"a": (75.0, 25.0, 0.0), "b": (None, None, None)}


def test_capped_values_lie_within_the_fences(spark):
    df = column(spark, [*range(100), 10_000, -10_000, None])
    lo, hi = L.fences(df, ["x"])["x"]
    got = [r.x for r in L.cap_outliers(df, ["x"]).collect()]
    assert got.count(None) == 1 and min(v for v in got if v is not None) == lo and max(v for v in got if v is not None) == hi


def test_standardize_constant_is_zero(spark):
    assert {r.x for r in L.standardize(column(spark, [3, 3, 3]), ["x"]).collect()} == {0.0}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    a, b = L.hash_split(df, "id", 0.75)
    c, _ = L.hash_split(df.repartition(13), "id", 0.75)
    assert a.count() + b.count() == 2000
    assert {r.id for r in a.collect()} == {r.id for r in c.collect()}


def test_lookup_ways_agree(spark, monkeypatch):
    rows = spark.range(900).select((F.col("id") % 7).alias("k"), "id").union(spark.range(300).select(F.lit(3), F.col("id")))
    dim = spark.range(5).select(F.col("id").alias("i"), (F.col("id") * 10).alias("v"))
    small = sorted(map(tuple, J.lookup(rows, dim, "k", "i").collect()))
    monkeypatch.setattr(J, "is_small", lambda *a: False)
    shuffled = sorted(map(tuple, J.lookup(rows, dim, "k", "i").collect()))
    assert small == shuffled and len(small) == sum(1 for i in range(900) if i % 7 < 5) + 300


def test_wide_rows_are_not_broadcast(spark):
    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    assert not J.is_small(rows) and J.is_small(rows.select("id"))
    plan = J.lookup(spark.range(10).toDF("k"), rows, "k", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_is_small_counts(spark):
    assert J.is_small(spark.range(10), rows=10)
    assert not J.is_small(spark.range(11), rows=10)


def test_net_by_week_full(spark):
    ar = spark.createDataFrame([(1, 5.0), (2, 1.0)], "week bigint, amount_ar double")
    ap = spark.createDataFrame([(2, 4.0), (3, 2.0)], "week bigint, amount_ap double")
    assert {tuple(r) for r in J.net_by_week(ar, ap).collect()} == {(2, 1.0, 4.0, -3.0)}
    full = {r.week: r.working_capital for r in J.net_by_week(ar, ap, how="full").collect()}
    assert full == {1: 5.0, 2: -3.0, 3: -2.0}


def test_flag_every_row_of_a_repeated_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = sorted(map(tuple, J.flag_members(df, keys, "k", "f").na.fill(-1).collect()))
    assert got == [(-1, False), (1, True), (1, True), (2, False)]


def test_column_statistics_of_queries_name_own_columns(spark, small):
    """A list of columns further down in the catalogue must not replace the one these queries and their SQL use."""
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    for name in ("medians", "quartiles", "moments"):
        assert [r.column_name for r in QUERIES[name](spark, small).collect()] == numbers
