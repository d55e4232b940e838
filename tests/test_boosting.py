"""Boosted trees from histograms: against exhaustive splits, by jobs, and as SQL."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerloom.operators import boosting as B


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), np.round(rng.normal(size=n), 2), rng.integers(0, 2, n), np.ones(n)], axis=1)
    y = np.where(x[:, 0] > 4, 6, -2) + 3 * x[:, 2] * (x[:, 1] > 0) + rng.integers(-1, 2, n)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, label double")


COLUMNS = ["a", "b", "c", "d"]


def best_split(x, y):
    """Gain of the best split of rows by trying every feature and value."""
    best = 0.0
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            parts = sum(y[m].sum() ** 2 / m.sum() for m in (left, ~left))
            best = max(best, parts - y.sum() ** 2 / len(y))
    return best


def test_first_split_is_the_best_of_all(spark):
    rows = table(spark, 300).toPandas()
    x, y = rows[["a", "c", "d"]].to_numpy(), rows.label.to_numpy()
    codes = np.stack([np.searchsorted(np.unique(x[:, f])[:-1], x[:, f]) for f in range(3)], axis=1).astype(np.uint8)
    gains = np.zeros(3)
    tree = B.empty_tree(1)
    B.grow_level(tree, 0, B.histograms(B.Bundles(codes, [9, 2, 1]), np.ones(300), y, np.zeros(300, int), 1), gains)
    assert abs(gains.sum() - best_split(x, y)) < 1e-6
    left = codes[:, tree.feature[0]] <= tree.bin[0]
    assert np.allclose(tree.predict(codes), np.where(left, y[left].mean(), y[~left].mean()))


def test_one_task_and_jobs_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 2)
    rows = table(spark, 400).repartition(5)
    one = B.fit_boosted(rows, COLUMNS, rounds=5)
    many = B.fit_boosted(rows, COLUMNS, rounds=5, small_groups=0)
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    assert np.allclose(one.importances, many.importances) and abs(sum(one.importances) - 1) < 1e-9
    assert one.importances[3] == 0  # a constant column splits nothing


def test_stage_predicts_and_can_be_saved(spark, tmp_path):
    rows = table(spark, 300)
    fit = B.fit_boosted(rows, COLUMNS, rounds=20)
    stage = B.BoostedTrees(inputCols=COLUMNS, model=fit.to_json())
    PipelineModel(stages=[stage]).write().overwrite().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(rows).toPandas()
    codes = np.stack([np.searchsorted(e, got[c].to_numpy()) for c, e in zip(COLUMNS, fit.edges)], axis=1).astype(np.uint8)
    assert np.allclose(got.prediction, sum(t.predict(codes) for t in fit.trees))


def test_as_good_as_the_library_on_other_rows(spark):
    train, test = table(spark, 3000, 1), table(spark, 2000, 2)
    fit = B.fit_boosted(train, COLUMNS, rounds=30, step=0.2)
    error = lambda df: df.agg(F.avg((F.col("label") - F.col("prediction")) ** 2) / F.var_pop("label")).first()[0]
    ours = error(B.BoostedTrees(inputCols=COLUMNS, model=fit.to_json()).transform(test))
    assembled = VectorAssembler(inputCols=COLUMNS, outputCol="features")
    theirs = error(GBTRegressor(maxIter=30, maxDepth=3).fit(assembled.transform(train)).transform(assembled.transform(test)))
    assert ours < theirs + 0.01


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 4.0)]])
def test_nothing_to_split(spark, rows):
    df = spark.createDataFrame(rows, "x double, label double")
    fit = B.fit_boosted(df, ["x"], rounds=3)
    want = sum(r[1] for r in rows) / len(rows) if rows else 0.0
    assert fit.predict([np.array([7.0])]).tolist() == [want]


def test_passes_over_many_groups_read_few_rows(spark, monkeypatch):
    """A job of a level reads packed rows, not one row a group."""
    rows = table(spark, 6000).withColumn("b", F.rand(3)).withColumn("d", F.rand(4))
    read = []
    plain = B.drop_path

    def count(session, path):
        read.append(session.read.parquet(path).count())
        plain(session, path)

    monkeypatch.setattr(B, "drop_path", count)
    B.fit_boosted(rows, COLUMNS, rounds=11, small_groups=0)
    groups = rows.count() // 4
    assert read and max(read) < groups // 20
