"""Batch readers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, format: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet, by ``format`` or else by suffix (``.csv``, also compressed)."""
    name = path.rstrip("/").lower()
    kind = format or ("csv" if name.endswith((".csv", ".csv.gz", ".csv.bz2", ".csv.zst")) else "parquet")
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    if kind == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated edges without header."""
    schema = "pid_1 bigint, pid_2 bigint, occurrence_ct bigint"
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def read_dimension(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    num_partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """Database table. Give a partition column and its bounds to read it in parallel.

    Credentials are options of the caller (``user``, ``password``).
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("a partitioned read needs lower, upper and num_partitions")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(num_partitions),
        )
    return reader.load()


def read_since(df: DataFrame, ts: str, last) -> DataFrame:
    """Rows later than the mark ``last``; all rows when there is no mark yet.

    The predicate is a plain comparison with a literal, so it reaches the scan.
    """
    return df if last is None else df.where(F.col(ts) > F.lit(last).cast(df.schema[ts].dataType))


def next_mark(df: DataFrame, ts: str):
    """Largest time read, the mark of the next incremental read."""
    return df.agg(F.max(ts)).first()[0]


def rows_to_df(spark: SparkSession, rows, schema) -> DataFrame:
    """Rows of the program as a DataFrame; for lookups, not for bulk data."""
    return spark.createDataFrame(rows, schema)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
