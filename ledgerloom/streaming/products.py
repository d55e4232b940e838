"""Enriched activity, live counts and points; every function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import merge_tags, tags_map
from ledgerloom.operators.joins import lookup


KEYS = ("measurement", "tags")


def tagged_demographics(dim: DataFrame) -> DataFrame:
    """(i, age, tags) with country, gender and state as tags."""
    return dim.select("i", "age", tags_map("country", "gender", "state").alias("dim_tags"))


def enrich_activity(activity: DataFrame, demographics: DataFrame) -> DataFrame:
    """Activity records with age and demographic tags; unknown users are dropped.

    ``activity`` has either the record columns or one ``activity`` struct.
    """
    if "activity" in activity.columns:
        activity = activity.select("activity.*")
    joined = lookup(activity, tagged_demographics(demographics), "id", "i")
    return joined.select(
        "id",
        "orderid",
        "campaignid",
        "total_amount",
        "units",
        "age",
        merge_tags(F.col("tags"), F.col("dim_tags")).alias("tags"),
    )


def live_country_count(activity: DataFrame, demographics: DataFrame) -> DataFrame:
    """Running number of activities per country."""
    if "activity" in activity.columns:
        activity = activity.select("activity.id")
    return lookup(activity.select("id"), demographics.select("i", "country"), "id", "i").groupBy("country").count()


def measurement_name(template: str, topic: str) -> str:
    """Measurement of a topic, for a template such as ``${topic}_1``."""
    return template.replace("${topic}", topic)


def partial_points(df: DataFrame, ts: str, fields: list[str], order: str | list[str], keys=KEYS) -> DataFrame:
    """Points whose fields are structs of the order and value of their latest record, and ``_order``, the latest of all.

    Every field keeps its own order, so these can be merged again with those of
    other batches, in any sequence.
    """
    order = [order] if isinstance(order, str) else list(order)
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("_value")))).alias(f) for f in fields]
    return df.groupBy(*keys, ts).agg(*latest, F.max(F.struct(*order)).alias("_order"))


def merge_partial_points(parts: DataFrame, ts: str, fields: list[str], keys=KEYS) -> DataFrame:
    return parts.groupBy(*keys, ts).agg(*[F.max(f).alias(f) for f in fields], F.max("_order").alias("_order"))


def finished_points(parts: DataFrame, ts: str, fields: list[str], keys=KEYS) -> DataFrame:
    return parts.select(*keys, ts, *[F.col(f"`{f}`._value").alias(f) for f in fields], "_order.*")


def merge_points(df: DataFrame, ts: str, fields: list[str], order: str | list[str], keys=KEYS) -> DataFrame:
    """One point per (measurement, tags, time): each field keeps its latest value that is set.

    ``order`` says which record is later. Offsets of different partitions do
    not compare, so records of a topic are ordered by timestamp, partition and
    offset.
    """
    return finished_points(partial_points(df, ts, fields, order, keys), ts, fields, keys)


def activity_points(df: DataFrame, measurement: str, ts: str, fields: list[str], order: str | list[str]) -> DataFrame:
    return merge_points(df.withColumn("measurement", F.lit(measurement)), ts, fields, order)
