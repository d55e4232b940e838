"""Streaming sinks. Every query that keeps progress asks for its own checkpoint folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.schemas import ENRICHED_TOPIC
from ledgerloom.session import drop_path
from ledgerloom.sinks.writers import write_dimension
from ledgerloom.streaming.products import finished_points, merge_partial_points, partial_points
from ledgerloom.streaming.sources import encode_activity


def _triggered(writer, trigger: str | None):
    """A time such as ``10 seconds``, or everything there is now and then stop."""
    return writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)


def write_activity(
    df: DataFrame, servers: str, checkpoint: str, topic: str = ENRICHED_TOPIC, codec: str = "avro",
    trigger: str | None = "0 seconds", schema_id: int | None = None, **options: str,
) -> StreamingQuery:
    """Append records to a Kafka topic. Needs the Kafka connector on the class path, and for Avro the schema's id."""
    writer = (
        encode_activity(df, codec, schema_id=schema_id)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .options(**options)
        .outputMode("append")
    )
    return _triggered(writer, trigger).start()


def start_enrichment(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append enriched records to Parquet files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).start(path)


def write_each_batch(
    df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete",
    trigger: str | None = "10 seconds",
) -> StreamingQuery:
    """Call ``fn(batch, batch_id)`` per micro-batch.

    A batch can be repeated after a failure, so ``fn`` must overwrite by batch
    id or, in complete mode, replace the whole result.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    return _triggered(writer, trigger).start()


def both(*writers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several sinks from one reading of the source."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for write in writers:
                write(batch, batch_id)
        finally:
            batch.unpersist()

    return fn


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<n>`` below ``path`` that were written to their end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(s.getPath().getParent().getName().rpartition("=")[2]) for s in found or [])


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer of a whole result as ``path/batch_id=<n>``; results before the last two are deleted.

    Nothing is overwritten that a reader may hold, and a batch that fails
    leaves the result before it in place.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        for old in _complete(spark, path, "batch_id")[:-2]:
            drop_path(spark, f"{path}/batch_id={old}")

    return fn


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result of ``replace_table``."""
    found = _complete(spark, path, "batch_id")
    if not found:
        raise FileNotFoundError(f"no batch has written a result below {path}")
    return spark.read.parquet(f"{path}/batch_id={found[-1]}")


def replace_database_table(url: str, table: str, **options: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that overwrites a database table and keeps its definition."""

    def fn(batch: DataFrame, _: int) -> None:
        write_dimension(batch, url, table, **options)

    return fn


def fresh_side(
    read: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """Batch writer that reads the static side again for every batch, and joins and writes with what it finds."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        write(join(batch, read()), batch_id)

    return fn


def start_live_count(counts: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str,
                     trigger: str | None = "10 seconds") -> StreamingQuery:
    """Complete-mode query that hands the whole count table to ``writer`` at every trigger."""
    return write_each_batch(counts, writer, checkpoint, "complete", trigger)


def debug_sink(df: DataFrame, mode: str = "complete", memory: str | None = None) -> StreamingQuery:
    """Print batches, or keep them in a table of this session under the name ``memory``."""
    writer = df.writeStream.outputMode(mode)
    if memory:
        return writer.format("memory").queryName(memory).start()
    return writer.format("console").option("truncate", False).start()


def write_points(
    df: DataFrame, path: str, checkpoint: str, ts: str, fields: list[str], order: str | list[str], trigger: str | None = None
) -> StreamingQuery:
    """Merged points of each batch under ``path/batch_id=<n>``; a repeated batch replaces itself.

    ``df`` has the columns ``measurement`` and ``tags``.
    """

    def fn(batch: DataFrame, batch_id: int) -> None:
        points = partial_points(batch, ts, fields, order)
        points.write.mode("overwrite").partitionBy("measurement").parquet(f"{path}/batch_id={batch_id}")

    return write_each_batch(df, fn, checkpoint, "append", trigger)


def _stored_points(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """Points of the newest compaction and of the batches after it, and those batches."""
    done = _complete(spark, path, "compacted")
    batches = [n for n in _complete(spark, path, "batch_id") if not done or n > done[-1]]
    parts = [f"{path}/compacted={n}" for n in done[-1:]] + [f"{path}/batch_id={n}" for n in batches]
    # every folder is a table of its own, partitioned by measurement
    tables = [spark.read.option("basePath", p).parquet(p) for p in parts]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out, batches


def read_points(spark: SparkSession, path: str, ts: str, fields: list[str]) -> DataFrame:
    """The points of all batches; field by field the record that the order of ``write_points`` puts last."""
    return finished_points(merge_partial_points(_stored_points(spark, path)[0], ts, fields), ts, fields)


def compact_points(spark: SparkSession, path: str, ts: str, fields: list[str]) -> None:
    """Merge the batches so far into ``path/compacted=<n>`` and delete them; run it beside no reader of old batches."""
    stored, batches = _stored_points(spark, path)
    if not batches:
        return
    merge_partial_points(stored, ts, fields).write.mode("overwrite").partitionBy("measurement").parquet(f"{path}/compacted={batches[-1]}")
    for n in batches:
        drop_path(spark, f"{path}/batch_id={n}")
    for n in _complete(spark, path, "compacted")[:-1]:
        drop_path(spark, f"{path}/compacted={n}")
