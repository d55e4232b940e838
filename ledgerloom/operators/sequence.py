"""Order-dependent operators that stay parallel when one group holds most rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import materialize

# A group above this many rows is cut into ranges instead of being sorted by one task.
HOT_ROWS = 2_000_000
# More ranges than this are made only of rows that would not fit them: every range is a task, whose status the driver gets.
PIECES = 1000


def _default_past_end(nxt: Column, default) -> Column:
    # ``nxt`` is a struct: NULL means there is no next row, a NULL inside is a NULL value.
    return F.when(nxt.isNull(), F.lit(default)).otherwise(nxt["v"])


def lead_in_group(df: DataFrame, group: str, order: list[str], value: str, default, out: str) -> DataFrame:
    """Plain window lead: one shuffle on the group."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(out, F.lead(value, 1, default).over(window))


def lead_in_hot_groups(
    df: DataFrame, group: str, order: list[str], value: str, default, out: str, pieces: int
) -> DataFrame:
    """Lead for few very large groups.

    Range partitioning on (group, order) cuts each group into consecutive
    pieces. The lead runs inside the pieces; the last row of a piece takes the
    first value of the next one, from a table with one row per piece.
    """
    cut = df.repartitionByRange(pieces, group, *order).withColumn("_piece", F.spark_partition_id())
    cut = materialize(cut, "pieces")
    inside = Window.partitionBy(group, "_piece").orderBy(*order)
    heads = cut.groupBy(group, "_piece").agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_head")
    )
    following = heads.select(
        group,
        "_piece",
        F.lead("_head").over(Window.partitionBy(group).orderBy("_piece")).alias("_after"),
    )
    led = cut.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
    return (
        led.join(following, [group, "_piece"], "left")
        .withColumn(out, _default_past_end(F.coalesce("_next", "_after"), default))
        .select(*df.columns, out)
    )


def split_hot(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of hot keys); ``hot`` has one row per hot key."""
    keys = hot.select(key)
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def next_in_session(
    df: DataFrame,
    session: str,
    order: list[str],
    value: str,
    default=-1,
    out: str = "next_value",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Value of the next row of the session; ``default`` only past its end.

    ``order`` must be unique within a session (time, then an id). A NULL next
    value stays NULL. Rows without a session are left out.
    """
    df = df.where(F.col(session).isNotNull())
    sizes = df.groupBy(session).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    if df.count() <= hot_rows:
        return lead_in_group(df, session, order, value, default, out)
    hot = materialize(sizes, "hot-sessions")
    if hot.isEmpty():
        return lead_in_group(df, session, order, value, default, out)
    cold, large = split_hot(df, session, hot)
    return lead_in_group(cold, session, order, value, default, out).unionByName(
        lead_in_hot_groups(large, session, order, value, default, out, pieces_for(hot, "_n", hot_rows))
    )


def pieces_for(hot: DataFrame, size: str, hot_rows: int) -> int:
    """Number of ranges that keeps each below ``hot_rows`` on average, or below ``HOT_ROWS`` if these would be too many."""
    rows = hot.agg(F.sum(size)).first()[0]
    return max(2, min(2 * ceil(rows / hot_rows), max(PIECES, 2 * ceil(rows / HOT_ROWS))))


def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` up to and including each row in a unique order.

    Rows are range-partitioned by the order; each piece sums its own rows and
    starts from the sum of the earlier pieces (one row per piece), so no task
    sees all rows.
    """
    cut = materialize(
        df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "running"
    )
    sums = cut.groupBy("_piece").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(starts), "_piece")
        .withColumn(name, F.col("_start") + F.sum(amount).over(inside))
        .select(*df.columns, name)
    )


def with_row_id(df: DataFrame, order: list[str], name: str = "ID") -> DataFrame:
    """Row number 1..n in the given unique order, without moving all rows to one task."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), order, "_one", name)
    return numbered.select(F.col(name).cast("bigint").alias(name), *df.columns)


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Row with the smallest order per key.

    Written as an aggregate, so copies are dropped before the shuffle; a
    ``row_number`` window would move and sort all of them.
    """
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
        .select(*df.columns)
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of the whole input; each task keeps only ``k`` rows."""
    return df.orderBy(*order).limit(k)
