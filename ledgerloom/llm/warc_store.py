"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds every different payload once,
under its SHA-256; ``records`` holds the exact header bytes of every record
(WARC header, HTTP header) and the digest of its payload. The original records
come back by joining both: header, payload, two line ends.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response and the others revisit it: their records end after
the HTTP header and name the response. Only digests and ids are grouped, with
counts combined before the shuffle; payload bytes are moved once, to pick one
row of each, and never by digest.

Cases: a null payload is empty; a null id counts as larger than any other, its
record id is that of a missing page; repeated rows are all responses or all
revisits; a line end in a URL is percent-encoded, a null URL leaves the field
out; other columns are ignored, whatever their names; an empty table gives two
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_LAST = (1 << 63) - 1
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(date: str) -> Column:
    """Header bytes of a record, from its columns."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("n").cast("string"), F.lit(_END * 2),
    )
    response = F.col("kind") == "response"
    block = F.octet_length(http) + F.when(response, F.col("n")).otherwise(0)
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    warc = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", F.col("kind")), _field("WARC-Record-ID", _urn(F.col("page"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", safe),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, "").otherwise(F.concat(_field("WARC-Refers-To", _urn(F.col("first"))), _field("WARC-Profile", F.lit(_PROFILE)))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
    )
    return F.concat(warc, F.lit(_END), http).cast("binary")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` below ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    source.select(
        "page", "url", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha256"),
        base32_sha1(F.col("payload")).alias("sha1"), F.coalesce("page", F.lit(_LAST)).alias("order"),
    ).write.option("compression", "zstd").parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    facts.groupBy("sha256").agg(F.min("order").alias("least_order"), F.min("page").alias("first")).write.parquet(f"{path}/firsts")
    firsts = spark.read.parquet(f"{path}/firsts")

    joined = facts.join(firsts, "sha256").withColumn(
        "kind", F.when((F.col("n") < least) | (F.col("order") == F.col("least_order")), "response").otherwise("revisit")
    )
    joined.select("sha256", _header(date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")

    # the window takes the partitions of the join, so payload bytes are shuffled once
    keyed = source.select(F.coalesce("page", F.lit(_LAST)).alias("order"), F.sha2("payload", 256).alias("sha256"), "payload")
    once = Window.partitionBy("order", "sha256").orderBy("order")
    chosen = (
        keyed.join(firsts.select("sha256", F.col("least_order").alias("order")), ["order", "sha256"])
        .withColumn("copy", F.row_number().over(once)).where("copy = 1")
    )
    chosen.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads (sha256, payload, payload_bytes, payload_digest); a payload that is not its digest's raises."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256")))
    )
    return stored.select(
        sound.alias("sha256"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )


def _value(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?:^|\n){name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _page_of(field: Column) -> Column:
    return F.regexp_extract(field, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: what their headers say, and ``record``, their exact bytes.

    A record whose stated length is not that of its parts raises.
    """
    headers = spark.read.parquet(f"{path}/records").select(
        "sha256", "header", _value("WARC-Type").alias("record_type"), _page_of(_value("WARC-Record-ID")).alias("page_id"),
        _value("WARC-Target-URI").alias("url"), _page_of(_value("WARC-Refers-To")).alias("refers_to"),
        _value("WARC-Payload-Digest").alias("stated_digest"), _value("Content-Length").cast("long").alias("stated_length"),
        (F.octet_length("header") - F.octet_length(F.substring_index(F.col("header").cast("string"), _END * 2, 1)) - 4).alias("http_bytes"),
    )
    joined = headers.join(read_payloads(spark, path), "sha256")
    response = F.col("record_type") == "response"
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    length = F.col("http_bytes") + F.when(response, F.col("payload_bytes")).otherwise(0)
    sound = (F.col("stated_length") == length) & (F.col("stated_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return joined.select(
        "page_id", "url",
        F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.lit("record differs from its header"))).alias("record_type"),
        "refers_to", "payload_bytes", "payload_digest", "payload",
        F.concat("header", body, F.lit((_END * 2).encode())).alias("record"),
    )
