"""Input schemas, and the Avro record text derived from them."""

from __future__ import annotations

import json

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())


def _ints(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names]


# Field names and order of the two activity records.
CONSUMER_ACTIVITY = T.StructType(
    _ints("id", "campaignid", "orderid", "total_amount", "units") + [T.StructField("tags", TAGS)]
)
ACTIVITY_DEMOGRAPHICS = T.StructType(
    _ints("id", "orderid", "campaignid", "total_amount", "units", "age")
    + [T.StructField("tags", TAGS)]
)

PRODUCT_EVENTS = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# Topic names.
ACTIVITY_TOPIC = "consumer_activity"
ENRICHED_TOPIC = "user_activity_demographics"

_AVRO_NAMES = {
    T.IntegerType: "int",
    T.LongType: "long",
    T.FloatType: "float",
    T.DoubleType: "double",
    T.StringType: "string",
    T.BooleanType: "boolean",
    T.BinaryType: "bytes",
}


def _avro_type(dtype: T.DataType):
    if isinstance(dtype, T.MapType):
        return {"type": "map", "values": _avro_type(dtype.valueType)}
    if isinstance(dtype, T.ArrayType):
        return {"type": "array", "items": _avro_type(dtype.elementType)}
    return _AVRO_NAMES[type(dtype)]


def avro_record(name: str, schema: T.StructType) -> str:
    """Avro record text of a flat Spark schema, for from_avro / to_avro."""
    fields = [{"name": f.name, "type": _avro_type(f.dataType)} for f in schema]
    return json.dumps({"type": "record", "name": name, "fields": fields})
