"""Batch writers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Overwrite a Parquet table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_edge_list(df: DataFrame, path: str) -> None:
    """Edges as tab-separated text without header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_dimension(df: DataFrame, url: str, table: str, num_partitions: int = 8, **options: str) -> None:
    """Overwrite a database table, keeping its definition.

    ``num_partitions`` bounds the connections that are open at once.
    """
    (
        df.write.format("jdbc")
        .options(url=url, dbtable=table, truncate="true", numPartitions=str(num_partitions), **options)
        .mode("overwrite")
        .save()
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
