"""Churn: training and scoring, with everything learned frozen in one saved pipeline."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import clip
from ledgerloom.functions.frames import key_first, split_by_type
from ledgerloom.operators.aggregates import class_counts
from ledgerloom.operators.features import fences, hash_split, smote
from ledgerloom.operators.joins import flag_members
from ledgerloom.operators.profile import medians, moments
from ledgerloom.session import materialize, spread, temporary_tables

# Column names of the customer table.
KEY, LABEL, TIER = "CustomerID", "Churn", "CityTier"
CASHBACK, ORDERS = "CashbackAmount", "OrderCount"


@dataclass
class ChurnFit:
    model: PipelineModel
    train_accuracy: float
    test_accuracy: float
    before: tuple[int, int]  # (positive, negative) rows of the training part
    after: tuple[int, int]  # the same after oversampling


def first_levels(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Smallest value of every categorical column that has two values or more."""
    if not cols:
        return {}
    text = {c: F.col(f"`{c}`").cast("string") for c in cols}
    row = df.agg(*[F.struct(F.min(t), F.max(t)) for t in text.values()]).first()
    return {c: low for c, (low, high) in zip(cols, row) if low != high}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def fit_preparation(df: DataFrame, exclude: tuple[str, ...] = ()) -> list:
    """Stages that turn a customer table into ``features``.

    Numeric columns: NULL to median, capped at the fences, standardised.
    Text columns and the city tier: one 0/1 place per level but the first, in
    sparse vectors; NULL and levels not seen here are 0 in all. The levels are
    kept in the model, so name id-like columns in ``exclude``.
    Cashback per order is the ratio of the capped columns and is not scaled;
    0 where there are no orders.
    """
    cat, num = split_by_type(df, categorical=(TIER,), exclude=(KEY, LABEL, *exclude))
    fill = medians(df, num)
    num = [c for c in num if fill[c] is not None]
    full = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fill[c]))).alias(c) for c in num])
    bound = fences(full, num)
    capped = full.select(*[clip(F.col(f"`{c}`"), *bound[c]).alias(c) for c in num])
    scale = moments(capped, num)
    lowest = first_levels(df, cat)

    names = {c: f"n{i}_" + re.sub(r"\W", "_", c) for i, c in enumerate(num)}
    first = [
        f"greatest(least(coalesce(CAST(`{c}` AS DOUBLE), {_number(float(fill[c]))}), "
        f"{_number(bound[c][1])}), {_number(bound[c][0])}) AS {names[c]}"
        for c in num
    ]
    second, inputs = [], []
    for c in num:
        mean, deviation = scale[c]
        value = f"({names[c]} - {_number(mean)}) / {_number(deviation)}" if deviation else _number(0.0)
        second.append(f"{value} AS s_{names[c]}")
        inputs.append(f"s_{names[c]}")
    if CASHBACK in names and ORDERS in names:
        second.append(f"coalesce(try_divide({names[CASHBACK]}, {names[ORDERS]}), 0.0D) AS cashback_per_order")
        inputs.append("cashback_per_order")
    coded = []
    for i, c in enumerate(cat):
        if c in lowest:
            second.append(f"nullif(CAST(`{c}` AS STRING), {_quoted(lowest[c])}) AS l{i}")
            coded.append(i)
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(first)} FROM __THIS__" if first else "SELECT * FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {', '.join(second)} FROM __THIS__" if second else "SELECT * FROM __THIS__"),
    ]
    if coded:
        indexer = StringIndexer(
            inputCols=[f"l{i}" for i in coded], outputCols=[f"i{i}" for i in coded], handleInvalid="keep", stringOrderType="alphabetAsc"
        )
        # the last place of an index is that of NULL and unseen levels, which dropLast leaves out
        encoder = OneHotEncoder(inputCols=[f"i{i}" for i in coded], outputCols=[f"c{i}" for i in coded], dropLast=True)
        ready = PipelineModel(stages=stages).transform(df)
        stages.append(indexer.fit(ready))
        stages.append(encoder.fit(stages[-1].transform(ready)))
        inputs += [f"c{i}" for i in coded]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_churn(
    df: DataFrame, trees: int = 100, depth: int = 10, train_share: float = 0.75, seed: int = 42, exclude: tuple[str, ...] = (),
) -> ChurnFit:
    """Train on a hash split; only the training part is oversampled."""
    with temporary_tables():
        return _fit_churn(materialize(df, "churn"), trees, depth, train_share, seed, exclude)


def _fit_churn(df: DataFrame, trees: int, depth: int, train_share: float, seed: int, exclude: tuple[str, ...]) -> ChurnFit:
    stages = fit_preparation(df, exclude)
    ready = PipelineModel(stages=stages).transform(df).select(
        F.col(KEY), F.col(LABEL).cast("double").alias("label"), "features"
    )
    ready = materialize(ready, "churn-features")
    train, test = hash_split(ready, KEY, train_share, seed)
    rows = train.select(vector_to_array("features").alias("x"), "label")
    made = smote(rows, "x", "label")
    full = train.select("features", "label").unionByName(made.select(array_to_vector("x").alias("features"), "label"))
    full = materialize(full, "churn-train")
    # More memory per pass lets a level of all trees be grown from fewer scans.
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=1, maxMemoryInMB=1024).fit(spread(full))
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    return ChurnFit(
        PipelineModel(stages=[*stages, forest]),
        judge.evaluate(forest.transform(full)),
        judge.evaluate(forest.transform(test)),
        tuple(class_counts(rows, "label").first()),
        tuple(class_counts(full, "label").first()),
    )


def score_churn(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Input rows plus boolean ``churn``, key first. A ``Churn`` column may be there or not.

    A customer with several rows is flagged on all of them when one is
    predicted to churn. The output name differs from an input ``Churn`` only
    in case, so that column is left out.
    """
    churners = model.transform(df).where(F.col("prediction") == 1).select(KEY)
    return key_first(flag_members(df.drop(LABEL), churners, KEY, "churn"), KEY)
