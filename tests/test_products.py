"""Churn and working-capital plans on small made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.plans import capital, churn, coview, recommend as R
from ledgerloom.sinks.writers import save_model
from ledgerloom.sources.readers import load_model

CUSTOMERS = (
    "CustomerID bigint, Churn int, CityTier int, CashbackAmount double, OrderCount double, Tenure double, Device string"
)


@pytest.fixture(scope="module")
def customers(spark):
    rows = []
    for i in range(300):
        gone = i % 5 == 0
        rows.append((i, int(gone), i % 3 + 1, 100.0 + i % 17, None if i % 11 == 0 else 1.0 + i % 4,
                     (1.0 if gone else 20.0) + i % 3, "it's" if i % 2 else "phone"))
    return spark.createDataFrame(rows, CUSTOMERS)


@pytest.fixture(scope="module")
def fitted(customers):
    return churn.fit_churn(customers, trees=10, depth=4)


def test_churn_is_learned(fitted):
    assert fitted.test_accuracy > 0.95
    positive, negative = fitted.before
    assert positive < negative and fitted.after == (negative, negative)


def test_churn_scores_keep_input(spark, customers, fitted, tmp_path):
    save_model(fitted.model, str(tmp_path / "m"))
    model = load_model(str(tmp_path / "m"))
    scored = churn.score_churn(customers, model)
    assert scored.columns == ["CustomerID", "CityTier", "CashbackAmount", "OrderCount", "Tenure", "Device", "churn"]
    unlabeled = churn.score_churn(customers.drop("Churn"), model)
    assert sorted(map(str, scored.collect())) == sorted(map(str, unlabeled.collect()))
    truth = {r.CustomerID: bool(r.Churn) for r in customers.collect()}
    hits = sum(truth[r.CustomerID] == r.churn for r in scored.collect())
    assert hits > 290


def test_scoring_uses_the_training_statistics(spark, customers, fitted):
    """One row scores as it does within the whole table."""
    whole = {r.CustomerID: r.churn for r in churn.score_churn(customers, fitted.model).collect()}
    alone = churn.score_churn(customers.where("CustomerID = 25"), fitted.model).first()
    assert alone.churn == whole[25]


def test_preparation_values(spark, customers):
    from pyspark.ml import PipelineModel

    stages = churn.fit_preparation(customers)
    out = PipelineModel(stages=stages).transform(customers)
    scaled = [c for c in out.columns if c.startswith("s_")]
    stats = out.agg(*[F.round(F.avg(c), 9).alias(f"a{c}") for c in scaled],
                    *[F.round(F.stddev_pop(c), 9).alias(f"d{c}") for c in scaled]).first()
    assert list(stats) == [0.0] * len(scaled) + [1.0] * len(scaled)
    row = out.where("CustomerID = 11").first()  # order count missing: the median 2.0 or 3.0 steps in
    assert row.cashback_per_order == (100.0 + 11) / row["n1_OrderCount"]
    assert stages[-1].getInputCols()[-2:] == ["c0", "c1"]
    assert (len(row.c0), len(row.c1)) == (2, 1)


def test_levels_are_zero_when_first_missing_or_unseen(spark):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "a"), (3, 3.0, "c"), (4, 4.0, None)], "CustomerID int, n double, t string")
    model = PipelineModel(stages=churn.fit_preparation(df))
    more = df.union(spark.createDataFrame([(5, 1.0, "zz")], df.schema))
    got = {r.CustomerID: list(r.c0.toArray()) for r in model.transform(more).collect()}
    assert got == {1: [1, 0], 2: [0, 0], 3: [0, 1], 4: [0, 0], 5: [0, 0]}


def test_twenty_thousand_levels_train(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier

    df = spark.range(20_001).select(
        F.col("id").alias("CustomerID"), (F.col("id") % 7).cast("double").alias("n"), F.col("id").cast("string").alias("t"),
        (F.col("id") % 7 < 3).cast("double").alias("label"),
    )
    ready = PipelineModel(stages=churn.fit_preparation(df.drop("label"))).transform(df).select("features", "label")
    assert len(ready.first().features) == 1 + 20_000
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1, featureSubsetStrategy="all").fit(ready)
    assert forest.transform(ready).where("prediction <> label").count() == 0


def test_coview_graph_on_the_declared_schema(spark):
    rows = [
        ("2020-01-01 00:00:01 UTC", "view", 5, None, 1, "s"), ("2020-01-01 00:00:02 UTC", "view", 9, "a.b", 1, "s"),
        ("2020-01-01 00:00:03 UTC", "view", 5, None, 1, "s"), ("2020-01-01 00:00:01 UTC", "view", 7, None, 2, None),
        ("2020-01-01 00:00:05 UTC", "view", 3, None, 2, "t"), ("2020-01-01 00:00:05 UTC", "cart", 4, None, 2, "t"),
        ("2020-01-01 00:00:05 UTC", "view", 4, None, 2, "t"),
    ]
    df = spark.createDataFrame(rows, schemas.PRODUCT_EVENTS)
    want = {(9, 5, 2), (4, 3, 2)}
    assert {tuple(r) for r in coview.coview_graph(df).collect()} == want
    assert {tuple(r) for r in coview.coview_graph(df.repartition(5), hot_rows=2).collect()} == want


RECEIVABLES = [
    # customer, invoice, posting, due, baseline, paid, amount, payterm, dunning, open, limit, region
    ("c1", "i1", "1/1/2020", "1/31/2020", "1/1/2020", "1/28/2020", "10.25", "30", "1", 0, "500", "WEST"),
    ("c1", "i2", "1/2/2020", "1/31/2020", "1/1/2020", "2/2/2020", "30", "30", "3", 0, "700", "WEST"),
    ("c1", "i3", "1/2/2020", "1/31/2020", "1/1/2020", "", "5", "30", "3", 1, "700", "WEST"),
    ("c2", "i4", "1/5/2020", "2/4/2020", "1/5/2020", "2/4/2020", "7.35", "30", "0", 0, "100", "MIDWEST"),
    ("c2", "i5", "1/5/2020", "2/4/2020", "1/5/2020", "", "7.35", "30", "0", 0, "100", "NOWHERE"),
]


@pytest.fixture(scope="module")
def receivables(spark):
    return spark.createDataFrame(RECEIVABLES, list(capital.RECEIVABLE_NAMES))


def test_receivable_rows(receivables):
    rows = {r.invoice_id: r for r in capital.receivable_rows(capital.clean_receivables(receivables), 0).collect()}
    assert set(rows) == {"i1", "i2", "i4", "i5"}
    assert [rows[i].delay for i in ("i1", "i2", "i4", "i5")] == [3, -2, 0, None]
    assert [rows[i].state for i in ("i1", "i2", "i4", "i5")] == ["early", "late", "ontime", "NA"]
    a = rows["i1"]
    assert (a.amount, a.inv_count, a.credit_limit_mean, a.dunnlevel_mean, a.diff_pb) == (10.2, 2, 600.0, 2.0, 0)
    assert (a.WEST, a.MIDWEST, a.NORTHEAST) == (1, 0, 0) and rows["i2"].diff_pb == 1
    assert abs(a.TA_early - 10.2 / 40.2 * 100) < 1e-9 and a.TA_ontime == 0.0
    assert rows["i4"].TA_NA == 50.0 and rows["i5"].WEST == 0


def test_open_rows_have_no_delay(receivables):
    rows = capital.receivable_rows(capital.clean_receivables(receivables), 1)
    assert "delay" not in rows.columns and [r.invoice_id for r in rows.collect()] == ["i3"]


def test_bad_date_raises(spark, receivables):
    bad = receivables.withColumn("Due_Date", F.lit("31st of May"))
    with pytest.raises(Exception):
        capital.clean_receivables(bad).collect()


def test_payables_keep_missing_status(spark):
    def bill(number, status, paid):
        return ("s1", number, status, "2020-01-10", "2/9/2020", "2020/01/08", paid, 10.0, 1.0, 9.0, 0.5, "30", "Taxes", "Domestic")

    raw = spark.createDataFrame(
        [bill("n1", "Paid", "2020-02-01"), bill("n2", None, "15-Feb-2020"), bill("n3", "Unpaid", None)],
        ", ".join(f"`{c}` {'double' if c in ('Invoice Amount', 'Overdue', 'Total Outstanding amount', 'Late payment fees') else 'string'}"
                  for c in capital.PAYABLE_NAMES),
    )
    clean = capital.clean_payables(raw)
    paid = {r.invoice_number: r for r in capital.payable_rows(clean, False).collect()}
    assert {k: r.delay for k, r in paid.items()} == {"n1": 8, "n2": -6}
    assert paid["n1"]["Spend Category_Taxes"] == 1 and paid["n1"]["Vendor_Type_International"] == 0
    assert paid["n1"].diff_pb == 2 and paid["n1"].inv_count == 2
    assert [r.invoice_number for r in capital.payable_rows(clean, True).collect()] == ["n3"]


class Constant:
    """Stands for a fitted model: the same delay for every row."""

    def __init__(self, days):
        self.days = days

    def transform(self, df):
        return df.withColumn("prediction", F.lit(self.days))


def test_predicted_date_and_sign(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 10),)], "due_date date")
    plus = capital.with_predicted_week(rows, Constant(-0.5)).first()
    minus = capital.with_predicted_week(rows, Constant(-3.0), sign=-1).first()
    assert (plus.predicted_date, plus.week) == (dt.date(2020, 1, 9), 2)
    assert (minus.predicted_date, minus.week) == (dt.date(2020, 1, 13), 3)


def test_recommendation_of_given_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "pid bigint, embedding_vector array<float>")
    products = spark.createDataFrame([(1, "a.b"), (2, None), (2, "c.d"), (3, None)], "product_id bigint, category_code string")
    ids = spark.createDataFrame([(1,), (77,)], "id bigint")
    assert [tuple(r) for r in R.recommend(vectors, products, ids).collect()] == [(1, "2", "c.d", 1)]
    mapped = R.embedding_map(vectors, products)
    assert {r.pid for r in mapped.collect()} == {1, 2} and {"L1", "L2", "L3", "x0", "x1"} <= set(mapped.columns)


def test_training_leaves_no_tables_behind(spark, receivables):
    import os
    from urllib.parse import urlparse

    from ledgerloom.session import checkpoint_root

    root = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    capital.fit_receivables(receivables, iterations=2)
    assert set(os.listdir(root) if os.path.isdir(root) else []) == before
