"""The numbered queries: each applies its operator to the whole table and derives the asked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import (
    column_bwt, impact_index, lattice_hash, license_rules, near_dedup, oracles, periodic_runs, pow2_pack, quality_sketch, source_mix,
    superkmer, toxicity, turn_grammar, warc_store,
)
from ledgerloom.session import scratch_path

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_minhash_dedup(spark, sf_dir):
    """Components of documents whose shingle sets are similar to 85 in 100."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("_hash")


@query
def op2_pfair_mix(spark, sf_dir):
    """Block and slot of every document in a mixture of sources."""
    return source_mix.mix_sources(_table(spark, sf_dir, "documents")).drop("_hash")


@query
def op3_sentence_licences(spark, sf_dir):
    """Known licence sentences of every document and the licences whose rules they match."""
    found = license_rules.scan_licences(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"),
    )


@query
def op4_warc_archive(spark, sf_dir):
    """Records of all pages, written to an archive and read back."""
    path = scratch_path(spark, "warc")
    warc_store.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc_store.read_records(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op5_impact_top_k(spark, sf_dir):
    """Five largest integer inner products of every fiftieth vector."""
    found = impact_index.exact_top_k(_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", "vec_id", "score")


@query
def op6_sketch_quality(spark, sf_dir):
    """Measures of all texts, and whether they lie within the fences of their language and source."""
    judged = quality_sketch.adaptive_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op7_bigru_toxicity(spark, sf_dir):
    """Score of the worst window of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxic_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op8_column_bwt_dedup(spark, sf_dir):
    """Bytes kept after removing every 200-byte string that starts elsewhere too."""
    done = column_bwt.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query
def op9_pow2_packing(spark, sf_dir):
    """Pieces of power-of-two length, each a sequence of its own."""
    return pow2_pack.piece_digests(pow2_pack.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op10_superkmer_dedup(spark, sf_dir):
    """Words kept after removing 13-word windows that a smaller document has."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = superkmer.drop_repeats(docs)
    return done.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by the checksum of ``conv_id:turn``: dropped, emptied, cut, repeated, or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (
        turns.where(fault != 0)
        .select(
            "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


@query
def op11_cyk_repair(spark, sf_dir):
    """Faults, cheapest repair and repaired transcript of every damaged conversation."""
    turns = _table(spark, sf_dir, "conversations")
    damaged = damaged_turns(turns)
    verdicts = turn_grammar.audit_conversations(damaged)
    digests = turn_grammar.transcript_digests(damaged, verdicts)
    same = lambda df, name: df.select(F.col("conv_id").alias(name), *(c for c in df.columns if c != "conv_id"))
    whole = turns.select("conv_id").distinct()
    whole = whole.join(same(verdicts, "v"), F.col("conv_id").eqNullSafe(F.col("v")), "left")
    whole = whole.join(same(digests, "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op12_lattice_dedup(spark, sf_dir):
    """Links and components of vectors of one label whose cosine is 0.98 or more."""
    return lattice_hash.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def repeating_documents(docs: DataFrame) -> DataFrame:
    """Documents; of a tenth of them, by the checksum of the id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        cycle = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " "))

    text = F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, and its text without their repeats."""
    found = periodic_runs.find_runs(repeating_documents(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs_sha256", "collapsed")
    length = -F.col("best.less")
    return found.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256",
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLES: dict[str, str] = {
    "op1_minhash_dedup": oracles.OP1, "op3_sentence_licences": oracles.OP3, "op4_warc_archive": oracles.OP4,
    "op5_impact_top_k": oracles.OP5, "op6_sketch_quality": oracles.OP6, "op10_superkmer_dedup": oracles.OP10,
    "op11_cyk_repair": oracles.OP11, "op12_lattice_dedup": oracles.OP12, "op13_periodic_runs": oracles.OP13,
}
