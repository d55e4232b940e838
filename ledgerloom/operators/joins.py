"""Joins with a measured side, flags, enrichment.

The side with one row per key is dealt anew before the join. Adaptive execution
then knows its size: a small one is broadcast and the rows do not move, and for
a large one it can split a hot key of the rows. An aggregate that feeds the join
directly would share its partitioning with it, and such a join is never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Bounds under which a side may be sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within both bounds: first its rows, counted up to the bound, then their bytes as text."""
    if df.limit(rows + 1).count() > rows:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= size


def dealt(df: DataFrame) -> DataFrame:
    """The rows in a shuffle of their own, whose sizes adaptive execution reads before it joins."""
    return df.hint("rebalance")


def sessions_with(df: DataFrame, session: str, value: str, where: Column) -> DataFrame:
    """Rows of sessions whose qualifying rows show more than one distinct value.

    ``count(distinct v) > 1`` is tested as ``min(v) <> max(v)``, which
    aggregates before the shuffle and needs no distinct step.
    """
    qualifying = (
        df.where(where & F.col(session).isNotNull() & F.col(value).isNotNull())
        .groupBy(session)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(session)
    )
    return df.join(dealt(qualifying), session, "left_semi")


def attach_features(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join of rows to one feature row per key."""
    return rows.join(dealt(features), key, "left")


def flag_members(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """True where the row's key occurs in ``keys``; every row of a repeated key is flagged."""
    members = dealt(keys.select(key).where(F.col(key).isNotNull()).distinct())
    return (
        df.join(members.withColumn("_hit", F.lit(True)), key, "left")
        .withColumn(name, F.coalesce("_hit", F.lit(False)))
        .select(*df.columns, name)
    )


def lookup(rows: DataFrame, dim: DataFrame, left: str, right: str) -> DataFrame:
    """Inner equi-join of rows to a dimension with unique keys.

    A batch broadcasts a dimension within the measured bounds; beyond them both
    sides are shuffled and adaptive execution splits a hot key. A stream gets
    no hint, since the dimension may grow while it runs: its batches choose by
    the size they find.
    """
    on = F.col(left) == F.col(right)
    if not rows.isStreaming and is_small(dim):
        return rows.join(F.broadcast(dim), on)
    return rows.join(dim, on)


def net_by_week(ar: DataFrame, ap: DataFrame, keys=("week",), how: str = "inner") -> DataFrame:
    """Receivable minus payable sums per week.

    ``inner`` leaves out weeks that only one side has; ``full`` counts the
    missing side as 0.
    """
    joined = ar.join(ap, list(keys), how).na.fill(0, ["amount_ar", "amount_ap"])
    return joined.withColumn("working_capital", F.col("amount_ar") - F.col("amount_ap"))
