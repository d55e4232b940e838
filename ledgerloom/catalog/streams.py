"""Streaming queries over the events file, run to completion, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import ACTIVITY_SQL, DEMOGRAPHICS_SQL, activity, demographics
from ledgerloom.functions.columns import single_tag
from ledgerloom.functions.frames import flatten_struct, pack
from ledgerloom.schemas import ACTIVITY_TOPIC, CONSUMER_ACTIVITY
from ledgerloom.session import scratch_path
from ledgerloom.streaming import products as P, sinks, sources


def _events_stream(spark, d):
    return sources.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def _finish(running):
    running.awaitTermination()
    if running.exception():
        raise running.exception()


def _flat(enriched):
    tags = [F.col("tags")[k].alias(k) for k in ("activity", "country", "gender", "state")]
    return enriched.select("id", "orderid", "campaignid", "total_amount", "units", "age", *tags)


_ENRICHED = f"""
WITH {ACTIVITY_SQL}, {DEMOGRAPHICS_SQL}
SELECT id, orderid, campaignid, total_amount, units, age, activity, country, gender, state
FROM act JOIN demo ON id = i
"""

_COUNTS = f"""
WITH {ACTIVITY_SQL}, {DEMOGRAPHICS_SQL}
SELECT country, count(*) AS count FROM act JOIN demo ON id = i GROUP BY country
"""


@query(_ENRICHED)
def enrich_activity(spark, d):
    return _flat(P.enrich_activity(activity(table(spark, d, "events")), demographics(spark, d)))


@query(_COUNTS)
def country_count(spark, d):
    return P.live_country_count(activity(table(spark, d, "events")), demographics(spark, d))


@query(_ENRICHED)
def stream_enrich_activity(spark, d):
    """Encoded values from a file stream, decoded, enriched and appended to a table."""
    values = sources.encode_activity(activity(_events_stream(spark, d)), "json")
    decoded = sources.decode_activity(values, codec="json")
    out = scratch_path(spark, "enriched")
    enriched = P.enrich_activity(decoded, demographics(spark, d))
    _finish(sinks.start_enrichment(enriched, out, scratch_path(spark, "progress")))
    return _flat(spark.read.schema(enriched.schema).parquet(out))


@query(_COUNTS)
def stream_country_count(spark, d):
    """Complete-mode count per country, written by each batch."""
    counts = P.live_country_count(activity(_events_stream(spark, d)), demographics(spark, d))
    out = scratch_path(spark, "counts")
    _finish(sinks.start_live_count(counts, sinks.replace_table(out), scratch_path(spark, "progress"), None))
    return sinks.read_newest(spark, out)


@query(f"""
WITH {ACTIVITY_SQL}, {DEMOGRAPHICS_SQL}, c AS (SELECT country, count(*) AS count FROM act JOIN demo ON id = i GROUP BY country)
SELECT 'first' AS sink, country, count FROM c UNION ALL SELECT 'second', country, count FROM c
""")
def stream_two_sinks(spark, d):
    """One reading of the stream feeds two tables."""
    counts = P.live_country_count(activity(_events_stream(spark, d)), demographics(spark, d))
    a, b = scratch_path(spark, "first"), scratch_path(spark, "second")
    writer = sinks.both(sinks.replace_table(a), sinks.replace_table(b))
    _finish(sinks.write_each_batch(counts, writer, scratch_path(spark, "progress"), "complete", None))
    tables = [
        sinks.read_newest(spark, p).select(F.lit(n).alias("sink"), "country", "count")
        for n, p in (("first", a), ("second", b))
    ]
    return tables[0].unionByName(tables[1])


@query(f"""
WITH {ACTIVITY_SQL} SELECT id, campaignid, orderid, total_amount, units, activity FROM act
""")
def decode_activity(spark, d):
    """Records packed into encoded values and decoded again to top-level columns."""
    values = sources.encode_activity(activity(table(spark, d, "events")), "json")
    decoded = flatten_struct(sources.decode_activity(values, CONSUMER_ACTIVITY, "json"), "activity")
    return decoded.select(
        "id", "campaignid", "orderid", "total_amount", "units", F.col("tags")["activity"].alias("activity")
    )


@query(f"""
WITH {ACTIVITY_SQL} SELECT id, campaignid, orderid, total_amount, units, activity FROM act
""")
def framed_activity(spark, d):
    """Records behind a registry's frame, as they are written and as they are read."""
    values = sources.encode_activity(activity(table(spark, d, "events")), "json", schema_id=7, framed=True)
    decoded = flatten_struct(sources.decode_activity(values, CONSUMER_ACTIVITY, "json", framed=True), "activity")
    return decoded.select(
        "id", "campaignid", "orderid", "total_amount", "units", F.col("tags")["activity"].alias("activity")
    )


@query(f"""
WITH {ACTIVITY_SQL.replace("FROM events", "FROM events WHERE event_id % 2 = 0")}, {DEMOGRAPHICS_SQL},
     {ACTIVITY_SQL.replace("act AS", "later AS").replace("FROM events", "FROM events WHERE event_id % 2 = 1")}
SELECT country, count(*) AS count FROM act JOIN demo ON id = i GROUP BY country
UNION ALL SELECT 'NEW ' || country, count(*) FROM later JOIN demo ON id = i GROUP BY country
""")
def stream_fresh_side(spark, d):
    """Counts per country of two batches; the static side changes between them and is read again."""
    dim, out, files = scratch_path(spark, "side"), scratch_path(spark, "fresh"), scratch_path(spark, "halves")
    events = table(spark, d, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).coalesce(1).write.mode("append").parquet(files)
    people = demographics(spark, d)
    sinks.replace_table(dim)(people, 0)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/part={batch_id}")
        sinks.replace_table(dim)(people.withColumn("country", F.concat(F.lit("NEW "), "country")), batch_id + 1)

    writer = sinks.fresh_side(lambda: sinks.read_newest(spark, dim), P.live_country_count, write)
    stream = activity(sources.file_stream(spark, files, events.schema, per_batch=1))
    _finish(sinks.write_each_batch(stream, writer, scratch_path(spark, "progress"), "append", None))
    return spark.read.parquet(out).select("country", "count")


_POINTS = f"""
SELECT '{ACTIVITY_TOPIC}_1' AS measurement, event_type AS activity,
       CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute,
       max_by(value, event_id) AS value, max_by(user_id, event_id) AS user_id, max(event_id) AS event_id
FROM events GROUP BY ALL
"""


def _points_input(events):
    return events.select(
        F.lit(P.measurement_name("${topic}_1", ACTIVITY_TOPIC)).alias("measurement"),
        single_tag("activity", F.col("event_type")).alias("tags"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"),
        "value",
        "user_id",
        "event_id",
    )


def _flat_points(points):
    return points.select(
        "measurement",
        F.col("tags")["activity"].alias("activity"),
        F.unix_timestamp("minute").alias("minute"),
        "value",
        "user_id",
        "event_id",
    )


@query(_POINTS)
def activity_points(spark, d):
    points = P.merge_points(_points_input(table(spark, d, "events")), "minute", ["value", "user_id"], "event_id")
    return _flat_points(points)


@query(_POINTS)
def stream_activity_points(spark, d):
    """Points merged per batch, stored by batch, and merged again when read.

    The events arrive in four batches whose records lie between one another.
    """
    out, files = scratch_path(spark, "points"), scratch_path(spark, "arriving")
    events = table(spark, d, "events")
    events.repartition(4, F.pmod("event_id", F.lit(4))).write.parquet(files)
    stream = _points_input(sources.file_stream(spark, files, events.schema, per_batch=1))
    args = ("minute", ["value", "user_id"], "event_id")
    _finish(sinks.write_points(stream, out, scratch_path(spark, "progress"), *args))
    return _flat_points(sinks.read_points(spark, out, *args[:2]))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
""")
def pack_columns(spark, d):
    """All columns packed into one struct and flattened again."""
    return flatten_struct(pack(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")), "value")
