"""Feature preparation: imputation, capping, splits, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import clip, standardized, unit_interval
from ledgerloom.operators.neighbours import nearest
from ledgerloom.operators.profile import correlated_columns, medians, moments, quartiles
from ledgerloom.operators.sequence import running_total, with_row_id
from ledgerloom.session import materialize

# Copies made from one vector are spread over tasks in batches of this many.
COPIES_PER_TASK = 10_000


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric NULLs become the exact median of their column."""
    fill = medians(df, cols)
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill[c]).cast("double")) for c in cols}
    )


def fences(df: DataFrame, cols: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """(lower, upper) bound of each column at ``k`` interquartile ranges outside the quartiles."""
    bounds = {}
    for c, (q1, q3) in quartiles(df, cols).items():
        if q1 is not None:
            bounds[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return bounds


def cap_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    return df.withColumns(
        {c: clip(F.col(f"`{c}`").cast("double"), *b) for c, b in fences(df, cols, k).items()}
    )


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    return df.withColumns({c: standardized(F.col(f"`{c}`"), *m) for c, m in moments(df, cols).items()})


def drop_correlated(df: DataFrame, cols: list[str], threshold: float = 0.8, keep=()) -> DataFrame:
    """Drop the later column of every pair correlated above the threshold."""
    return df.drop(*correlated_columns(df, cols, threshold, keep))


def in_first_part(key: Column, frac: float, seed: int = 42) -> Column:
    """True for a fixed ``frac`` of the keys, whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < round(frac * 1000)


def hash_split(df: DataFrame, key: str, frac: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first = in_first_part(F.col(f"`{key}`"), frac, seed)
    return df.where(first), df.where(~first)


def _reach(near: Column) -> Column:
    """Neighbours in order, each with the number of rows up to and including it."""

    def upto(i: Column) -> Column:
        return F.aggregate(F.slice(near, 1, i + 1), F.lit(0).cast("bigint"), lambda a, z: a + z["m"])

    return F.transform(near, lambda e, i: F.struct(e["y"].alias("y"), upto(i).alias("upto")))


def smote(
    df: DataFrame, features: str, label: str, k: int = 5, seed: int = 33, group_rows: int = 4096
) -> DataFrame:
    """Synthetic rows (features, label) that bring the smaller of two classes up to the larger.

    ``features`` is an ``array<double>``. Each synthetic row lies between a
    minority row and one of its ``k`` nearest minority rows. Equal vectors
    are searched once and carry their count: their copies are each other's
    neighbours at distance 0. Every minority row gets the same number of
    synthetic rows, the remainder being spread evenly, so the classes come out
    exactly equal. All draws are hashes of (vector, copy number, seed).
    """
    sizes = sorted((n, v) for v, n in df.groupBy(label).count().limit(3).collect())
    if len(sizes) != 2:
        raise ValueError("oversampling needs exactly two classes")
    (minor, value), (major, _) = sizes
    rows = (
        df.where(F.col(label) == F.lit(value))
        .groupBy(F.col(features).alias("x"))
        .agg(F.count("*").alias("n"))
    )
    vectors = materialize(with_row_id(rows, ["x"], "vid"), "minority")
    near = nearest(
        vectors.select(F.col("vid").alias("qid"), F.col("x").alias("vec")),
        vectors.select(F.col("vid").alias("pid"), F.col("x").alias("vec")),
        k,
        group_rows=group_rows,
    )
    others = (
        near.join(vectors.select(F.col("vid").alias("pid"), F.col("x").alias("y"), F.col("n").alias("m")), "pid")
        .groupBy(F.col("qid").alias("vid"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "m", "y"))).alias("near"))
        .select("vid", _reach(F.col("near")).alias("near"))
    )
    spread = running_total(vectors, ["vid"], "n", "upto")
    # Whole-number proportional shares: they add up to exactly major - minor.
    gap = F.lit(major - minor).cast("decimal(19,0)")
    made = [F.floor((upto * gap) / F.lit(minor).cast("decimal(19,0)"))
            for upto in (F.col("upto"), F.col("upto") - F.col("n"))]
    wanted = spread.withColumn("copies", (made[0] - made[1]).cast("bigint")).where("copies > 0")
    batches = (
        wanted.join(others, "vid", "left")
        .withColumn("batch", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES_PER_TASK))))
        .repartition("vid", "batch")
    )
    first = F.col("batch") * COPIES_PER_TASK + 1
    last = F.least(F.col("copies"), first + (COPIES_PER_TASK - 1))
    copies = batches.withColumn("copy", F.explode(F.sequence(first, last)))
    usable = min(k, minor - 1)
    # Which of the k neighbours: the own copies come first, then the others by distance.
    place = F.pmod(F.xxhash64("vid", "copy", F.lit(seed)), F.lit(max(usable, 1)))
    beyond = place - (F.col("n") - 1)
    other = F.get(F.filter("near", lambda e: e["upto"] > F.col("beyond")), F.lit(0))["y"]
    mate = F.when((F.col("beyond") < 0) | F.col("near").isNull(), F.col("x")).otherwise(other)
    u = unit_interval(F.col("vid"), F.col("copy"), F.lit(seed + 1))
    return (
        copies.withColumn("beyond", beyond)
        .withColumn("mate", mate)
        .withColumn("u", u)
        .select(
            F.zip_with("x", "mate", lambda a, b: a + F.col("u") * (b - a)).alias(features),
            F.lit(value).cast(df.schema[label].dataType).alias(label),
        )
    )
