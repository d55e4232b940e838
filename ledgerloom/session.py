"""Session defaults, and tables that cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the jobs are written for.

    Adaptive execution splits the hot partitions of equi-joins, joins small
    measured sides by broadcast and coalesces small shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch between Spark and Python; the default of 10,000 rows is tens of megabytes of texts,
#: held several times on both sides of every task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes too, unless it has a lower bound; rows do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Without it, the session's warehouse folder, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"


_open_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def temporary_tables():
    """Tables that ``materialize`` writes inside are deleted at the end; no result may read them later."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for spark, path in _open_scopes.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path whose table no result reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage, survives the loss of executors, and gives later joins a
    measured size to choose broadcast or shuffle by.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if _open_scopes:
        _open_scopes[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for data that is read many times."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
