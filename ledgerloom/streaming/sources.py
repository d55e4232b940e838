"""Streaming sources and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.schemas import ACTIVITY_TOPIC, CONSUMER_ACTIVITY, avro_record

# A registry-framed value starts with one marker byte and a four-byte schema id.
FRAME_BYTES = 5


def activity_stream(
    spark: SparkSession, servers: str, topic: str = ACTIVITY_TOPIC, group: str | None = None, **options: str
) -> DataFrame:
    """Kafka topic as a stream of ``key``, ``value``, ``topic``, ``partition``, ``offset``, ``timestamp``.

    Needs the Kafka connector on the class path.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.options(**options).load()


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
                per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they appear."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_batch)
        .parquet(folder)
    )


def framed_value(value: Column, schema_id: int) -> Column:
    """The value behind a marker byte and the schema id, as registries frame it."""
    return F.concat(F.lit(bytes(1) + schema_id.to_bytes(FRAME_BYTES - 1, "big")), value)


def unframed_value(value: Column) -> Column:
    """The value without its frame; one that has no frame ends the query."""
    marked = F.substring(value, 1, 1) == F.lit(bytes(1))
    cut = F.substring(value, FRAME_BYTES + 1, 2**31 - 1)
    return F.when(value.isNull() | (marked & (F.octet_length(value) >= FRAME_BYTES)), cut).otherwise(
        F.raise_error(F.lit("a value without marker byte and schema id"))
    )


def decode_activity(
    df: DataFrame, schema: T.StructType = CONSUMER_ACTIVITY, codec: str = "avro", framed: bool | None = None,
    name: str = "activity",
) -> DataFrame:
    """Replace the binary ``value`` by the record it holds, as one struct column.

    ``avro`` needs the Avro module on the class path; ``json`` reads text values.
    Unless ``framed`` says otherwise, Avro values have a registry's frame and
    JSON values have none. A value that cannot be read ends the query.
    """
    rest = [c for c in df.columns if c != "value"]
    value = unframed_value(F.col("value")) if _is_framed(codec, framed) else F.col("value")
    if codec == "json":
        record = F.from_json(value.cast("string"), schema, {"mode": "FAILFAST"})
    else:
        from pyspark.sql.avro.functions import from_avro

        record = from_avro(value, avro_record("ConsumerActivity", schema))
    return df.select(*rest, record.alias(name))


def _is_framed(codec: str, framed: bool | None) -> bool:
    if codec not in ("avro", "json"):
        raise ValueError(f"unknown codec {codec!r}")
    return codec == "avro" if framed is None else framed


def encode_activity(
    df: DataFrame, codec: str = "avro", record: str = "UserActivity", schema_id: int | None = None, framed: bool | None = None
) -> DataFrame:
    """All columns packed and encoded as one ``value`` column; a framed one needs the id of its schema."""
    frame = _is_framed(codec, framed)
    if frame and schema_id is None:
        raise ValueError("a framed value needs a schema_id")
    packed = F.struct(*df.columns)
    if codec == "json":
        value = F.to_json(packed).cast("binary")
    else:
        from pyspark.sql.avro.functions import to_avro

        value = to_avro(packed, avro_record(record, df.schema))
    return df.select((framed_value(value, schema_id) if frame else value).alias("value"))
