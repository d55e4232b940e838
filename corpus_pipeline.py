"""Corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts are packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes each result as Parquet in
the shared folder and reads it back as the next stage's documents.

Every stage bounds the Arrow batches of the session by bytes (``session.small_batches``).

Rows are matched to the verdicts of an operator by id and text hash, so rows
that repeat an id, and rows without one, are judged by their own text. Inside a
stage columns are named by their place, so any names may occur.

Cases, for all stages: rows may hold nulls in any column, and texts of any
length; rows that agree in id and text share their verdict, so repeated rows
stay or go together; an empty table gives an empty one. What each stage does
with null and empty texts is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import near_dedup, pow2_pack, source_mix, superkmer, toxicity
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.session import scratch_path, small_batches


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by place, and the new name of each column."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null or empty text scores 0 and stays. Rows do not move."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, at = _plain(docs)
    model = toxicity.fit(plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), labels)
    scored = toxicity.with_score(plain, model, "score", at["text"])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of links at 80 in 100.

    Texts without words, and rows without id, are linked with nothing and stay.
    """
    plain, at = _plain(docs)
    found = near_dedup.near_duplicates(plain, at["doc_id"], at["text"])
    gone = found.where("not kept").select(F.col(at["doc_id"]).alias("id"), F.col("_hash").alias("hash")).distinct()
    on = F.col(at["doc_id"]).eqNullSafe(F.col("id")) & (F.xxhash64(at["text"]) == F.col("hash"))
    return plain.join(gone, on, "left_anti").toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a text that loses words becomes its kept words, joined by one space.

    Texts of fewer than 13 words, null and empty ones stay as they are; rows
    without id come after all others. ``n_chars`` follows the new text.
    """
    plain, at = _plain(docs)
    done = superkmer.drop_repeats(plain, at["doc_id"], at["text"])
    changed = F.col("_removed") > 0
    new = {at["text"]: F.when(changed, F.col("_kept")).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        new[at["n_chars"]] = F.when(changed, F.length("_kept").cast(kind)).otherwise(F.col(at["n_chars"]))
    return done.withColumns(new).select(*plain.columns).toDF(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files hold consecutive slots, and rows lie in order in them.

    A null source is a source; a null or empty text counts one character.
    """
    plain, at = _plain(docs)
    key, text, source = at["doc_id"], at["text"], at["source"]
    placed = source_mix.mix_sources(plain, id_col=key, text_col=text, source_col=source).select(
        F.col(key).alias("id"), F.col("_hash").alias("hash"), F.col(source).alias("from"), "slot", "seat"
    )
    # rows that repeat one another in full share their places
    once = placed.groupBy("id", "hash", "from").agg(F.min(F.struct("slot", "seat")).alias("place"))
    on = F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("hash")) & F.col(source).cast("string").eqNullSafe(F.col("from"))
    joined = plain.join(once, on).select(*plain.columns, F.col("place.slot").alias("slot"), F.col("place.seat").alias("seat"))
    ordered = joined.repartitionByRange("slot", "seat").sortWithinPartitions("slot", "seat")
    return ordered.select(*plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their tokens' checksum; a null or empty text is its end mark alone."""
    small_batches(spark)
    return pow2_pack.piece_digests(pow2_pack.pack_documents(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_to_weights),
    ("packing", pack),
]

#: The scores and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
