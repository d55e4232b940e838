"""Streams over files: restart, repeated batches, merging; connectors that are not installed here."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.sources.readers import next_mark, read_dimension, read_since
from ledgerloom.streaming import products as P, sinks, sources

DIM = "i int, age int, gender string, state string, country string"


@pytest.fixture
def world(spark, tmp_path):
    folder = tmp_path / "in"
    dim = spark.createDataFrame([(1, 30, "MALE", "s", "USA"), (2, 40, "FEMALE", "t", "JAPAN")], DIM)

    def add(*ids):
        rows = [(i, 1, 2, 3, 4, {"activity": "Click"}) for i in ids]
        spark.createDataFrame(rows, schemas.CONSUMER_ACTIVITY).write.mode("append").parquet(str(folder))

    def stream():
        return sources.file_stream(spark, str(folder), schemas.CONSUMER_ACTIVITY)

    return add, stream, dim, tmp_path


def wait(q):
    q.awaitTermination()
    assert q.exception() is None


def test_enrichment_goes_on_after_restart(spark, world):
    add, stream, dim, tmp = world
    out, progress = str(tmp / "out"), str(tmp / "progress")
    add(1, 1, 9)
    wait(sinks.start_enrichment(P.enrich_activity(stream(), dim), out, progress))
    add(2)
    wait(sinks.start_enrichment(P.enrich_activity(stream(), dim), out, progress))
    got = sorted((r.id, r.age, r.tags["country"], r.tags["activity"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 30, "USA", "Click")] * 2 + [(2, 40, "JAPAN", "Click")]
    fields = [f.name for f in schemas.ACTIVITY_DEMOGRAPHICS]
    assert spark.read.parquet(out).columns == fields[:1] + fields[1:]


def test_live_count_keeps_state(spark, world):
    add, stream, dim, tmp = world
    out, progress = str(tmp / "counts"), str(tmp / "progress")
    for batch in ((1, 1, 9), (2, 1)):
        add(*batch)
        counts = P.live_country_count(stream(), dim)
        wait(sinks.start_live_count(counts, sinks.replace_table(out), progress, None))
    assert {tuple(r) for r in sinks.read_newest(spark, out).collect()} == {("USA", 3), ("JAPAN", 1)}


def test_stream_join_of_a_hot_key(spark, world):
    add, stream, dim, tmp = world
    add(*[1] * 50, 2)
    out = str(tmp / "out")
    wait(sinks.start_enrichment(P.enrich_activity(stream(), dim), out, str(tmp / "progress")))
    assert spark.read.parquet(out).groupBy("id").count().orderBy("id").collect() == [(1, 50), (2, 1)]


def test_count_without_complete_mode_is_rejected(spark, world):
    add, stream, dim, tmp = world
    add(1)
    with pytest.raises(PySparkException):
        sinks.write_each_batch(P.live_country_count(stream(), dim), lambda b, i: None, str(tmp / "p"), "append", None)


def test_debug_sink_and_time_trigger(spark, world):
    add, stream, dim, tmp = world
    add(1)
    q = sinks.debug_sink(P.live_country_count(stream(), dim), memory="counts")
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("USA", 1)]
    seen = []
    q = sinks.write_each_batch(stream(), lambda b, i: seen.append(b.count()), str(tmp / "p"), "append", "1 seconds")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1


def test_points_merge_field_by_field(spark):
    rows = [
        ("m", {"a": "1", "b": "2"}, 10, 1.0, None, 1),
        ("m", {"b": "2", "a": "1"}, 10, None, 7.0, 2),
        ("m", {"a": "1", "b": "2"}, 10, 5.0, None, 3),
        ("m", {"a": "1"}, 10, 9.0, 9.0, 4),
    ]
    df = spark.createDataFrame(rows, "measurement string, tags map<string,string>, ts int, x double, y double, offset int")
    got = {(len(r.tags), r.x, r.y, r.offset) for r in P.merge_points(df, "ts", ["x", "y"], "offset").collect()}
    assert got == {(2, 5.0, 7.0, 3), (1, 9.0, 9.0, 4)}


def test_repeated_batch_of_points_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([("m", {"a": "1"}, 10, 1.0, 1)], "measurement string, tags map<string,string>, ts int, x double, offset int")
    src, out = str(tmp_path / "in"), str(tmp_path / "points")
    for n in range(2):  # a lost checkpoint makes the same batch run again
        df.write.mode("overwrite").parquet(src)
        stream = sources.file_stream(spark, src, df.schema)
        wait(sinks.write_points(stream, out, str(tmp_path / f"progress{n}"), "ts", ["x"], "offset"))
    assert spark.read.parquet(out).count() == 1
    assert sinks.read_points(spark, out, "ts", ["x"]).count() == 1


def test_points_of_several_batches_are_ordered_and_compacted(spark, tmp_path):
    out, order = str(tmp_path / "points"), ["time", "partition", "offset"]
    schema = "measurement string, tags map<string,string>, ts int, x double, y double, time int, partition int, offset int"
    batches = [[(1.0, None, 5, 0, 90)], [(2.0, 7.0, 4, 1, 1)], [(3.0, None, 5, 1, 2), (None, 9.0, 3, 0, 80)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([("m", {"a": "1"}, 10, *r) for r in rows], schema)
        P.partial_points(df, "ts", ["x", "y"], order).write.partitionBy("measurement").parquet(f"{out}/batch_id={n}")
    read = lambda: [tuple(r)[3:] for r in sinks.read_points(spark, out, "ts", ["x", "y"]).collect()]
    assert read() == [(3.0, 7.0, 5, 1, 2)]
    sinks.compact_points(spark, out, "ts", ["x", "y"])
    assert read() == [(3.0, 7.0, 5, 1, 2)] and sinks._complete(spark, out, "batch_id") == []
    df = spark.createDataFrame([("m", {"a": "1"}, 10, 8.0, None, 6, 0, 91)], schema)
    P.partial_points(df, "ts", ["x", "y"], order).write.partitionBy("measurement").parquet(f"{out}/batch_id=3")
    assert read() == [(8.0, 7.0, 6, 0, 91)]


def test_a_failed_batch_leaves_the_result_before_it(spark, tmp_path):
    out = str(tmp_path / "table")
    write = sinks.replace_table(out)
    for n in range(4):
        write(spark.range(n + 1), n)
    (tmp_path / "table" / "batch_id=9").mkdir()
    assert sinks.read_newest(spark, out).count() == 4 and sinks._complete(spark, out, "batch_id") == [2, 3]


def test_static_side_is_read_for_every_batch(spark, world):
    add, stream, dim, tmp = world
    names, found = iter(["OLD", "NEW"]), []
    read = lambda: dim.select("i", F.lit(next(names)).alias("country"))
    write = sinks.fresh_side(read, P.live_country_count, lambda b, _: found.extend(map(tuple, b.collect())))
    for _ in range(2):
        add(1, 1)
        wait(sinks.write_each_batch(stream(), write, str(tmp / "progress"), "append", None))
    assert found == [("OLD", 2), ("NEW", 2)]


def test_database_batch_writer_passes_its_options(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sinks, "write_dimension", lambda df, *a, **o: seen.append((df.count(), a, o)))
    sinks.replace_database_table("jdbc:x:y", "t", user="u")(spark.range(3), 7)
    assert seen == [(3, ("jdbc:x:y", "t"), {"user": "u"})]


def test_a_broken_record_ends_the_query(spark):
    df = spark.createDataFrame([(b'{"id": 1}',), (b"{broken",)], "value binary")
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        sources.decode_activity(df, codec="json").collect()


def test_measurement_names():
    assert P.measurement_name("${topic}_1", "consumer_activity") == "consumer_activity_1"
    assert P.measurement_name("${topic}", "t") == "t"


def test_json_round_trip_and_unknown_codec(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, {"activity": "Click"})], schemas.CONSUMER_ACTIVITY)
    back = sources.decode_activity(sources.encode_activity(df, "json"), codec="json").select("activity.*")
    assert back.collect() == df.collect()
    with pytest.raises(ValueError):
        sources.decode_activity(df, codec="xml")


def test_avro_record_text():
    record = json.loads(schemas.avro_record("ConsumerActivity", schemas.CONSUMER_ACTIVITY))
    assert [f["name"] for f in record["fields"]] == ["id", "campaignid", "orderid", "total_amount", "units", "tags"]
    assert record["fields"][-1]["type"] == {"type": "map", "values": "string"}


def test_absent_connectors_say_so(spark):
    with pytest.raises(Exception):
        sources.activity_stream(spark, "host:9092", group="g")
    with pytest.raises(ValueError):
        read_dimension(spark, "jdbc:x:y", "t", partition_column="i")


def test_incremental_read(spark):
    df = spark.range(5).select(F.col("id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    mark = next_mark(df.where("id < 3"), "ts")
    assert [r.id for r in read_since(df, "ts", mark).collect()] == [3, 4]
    assert read_since(df, "ts", None).count() == 5


def test_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    framed = sources.encode_activity(df, "json", schema_id=258, framed=True)
    values = [bytes(r.value) for r in framed.collect()]
    assert all(v[:5] == b"\x00\x00\x00\x01\x02" and v[5:6] == b"{" for v in values)
    back = sources.decode_activity(framed, df.schema, "json", framed=True).select("activity.*")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="marker byte"):
        sources.decode_activity(sources.encode_activity(df, "json"), df.schema, "json", framed=True).collect()
    with pytest.raises(ValueError, match="schema_id"):
        sources.encode_activity(df, "json", framed=True)
    with pytest.raises(ValueError, match="schema_id"):
        sources.encode_activity(df)  # Avro values are framed unless told otherwise


def test_no_result_yet(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError, match="no batch"):
        sinks.read_newest(spark, str(tmp_path / "none"))
