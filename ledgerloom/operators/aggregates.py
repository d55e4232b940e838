"""Grouped sums, pivots, shares, counts. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import PAYMENT_STATES, iso_year, week_of


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count()


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return count_by(df, c).orderBy(F.desc("count"), c)


def class_counts(df: DataFrame, label: str, positive=1) -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == positive).alias("positive"),
        F.count_if(F.col(label) != positive).alias("negative"),
    )


def sum_by(df: DataFrame, keys: list[str], amount: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(amount).alias(name))


def pivot_sums(status: Column, amount: str, values, prefix: str) -> list[Column]:
    """One conditional sum per status, so that a pivot shares the pass of other aggregates."""
    return [
        F.coalesce(F.sum(F.when(status == v, F.col(amount))), F.lit(0.0)).alias(f"{prefix}{v}")
        for v in values
    ]


def pivot_sum(df: DataFrame, key: str, status: str, amount: str, values=PAYMENT_STATES, prefix="TA_") -> DataFrame:
    """Sum of the amount per key and status, statuses as columns, 0 where there is none."""
    return df.groupBy(key).agg(*pivot_sums(F.col(status), amount, values, prefix))


def row_percent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column as percent of the row total; NULL when the total is 0."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumns({c: F.try_divide(F.col(c), total) * 100 for c in cols})


def entity_features(df: DataFrame, key: str, counts: dict[str, str] = {}, means: dict[str, str] = {},
                    sums: dict[str, str] = {}, extra: list[Column] = ()) -> DataFrame:
    """Counts of non-null values, means and sums per entity in one pass (name -> column)."""
    aggregates = [F.count(c).alias(n) for n, c in counts.items()]
    aggregates += [F.avg(c).alias(n) for n, c in means.items()]
    aggregates += [F.sum(c).alias(n) for n, c in sums.items()]
    return df.groupBy(key).agg(*aggregates, *extra)


def sum_by_week(df: DataFrame, day: str, amount: str, name: str, with_year: bool = False) -> DataFrame:
    """Sum per ISO week; weeks of different years fall together unless ``with_year``."""
    keys = [week_of(F.col(day)).alias("week")]
    if with_year:
        keys.insert(0, iso_year(F.col(day)).alias("iso_year"))
    return df.groupBy(*keys).agg(F.sum(amount).alias(name))


def null_report(df: DataFrame) -> DataFrame:
    """(column, data type, nulls) for every column, from one pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"`{f.name}`").alias("nulls"),
        )
        for f in df.schema
    ]
    return row.select(F.inline(F.array(*entries)))
