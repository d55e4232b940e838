"""Near-duplicate documents by one-permutation MinHash.

1. One pass gives each document its set of five-word shingles as 64-bit
   hashes, the least hash in each of 384 bins of one permutation, the empty
   bins filled by optimal densification, and keys of bands of eight bins (48)
   from a threshold of 85 in 100 on, of seven (54) below.
   Documents with equal sets are one class from here on.
2. A bucket is a band key that two classes share. It gives a star of candidate
   edges from its smallest member, so pairs grow with members, not with their
   square. Hot buckets stay in pieces: counts combine before the shuffle, and
   members meet their centre in a join that adaptive execution splits.
3. Edges whose sizes or bins rule out the similarity are dropped (bins: seven
   standard deviations below it); the rest is confirmed on the full sets.
4. Members that are not connected to the others of a bucket form new stars
   against all of it, two centres a round, until a round links nothing new.
5. Members of buckets that still hold more open members than centres meet in an
   exact join of all of them: sets are ordered by rarity, and a pair at the
   threshold shares a shingle so early in both that enough can follow.
6. Classes are the connected components of all links, found by passing on
   least ids and jumping along them.

A pair at the threshold shares no band with chance (1 - 0.85^8)^48 = 2e-7 at 85
in 100, and (1 - 0.8^7)^54 = 3e-6 at 80.

Cases: a text without words, and a row without id, is linked with nothing; a
text of one to four words has its whole sequence as its only shingle; repeated
rows, and rows that share an id, are one document; all other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.words import chunks, grams, hash_strings, mix, split_words, whole
from ledgerloom.session import drop_path, scratch_path

SHINGLE = 5
BINS = 384
CENTRES = 2
_NONE = np.iinfo(np.uint64).max


def shingle_sets(texts, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text, lower-cased in A-Z."""
    words = split_words(texts, lower=True)
    coded = hash_strings(words.vocabulary)[words.ids]
    all_grams = grams(coded, width)
    out = []
    for start, n in zip(words.starts, words.counts):
        if n >= width:
            out.append(np.unique(all_grams[start : start + n - width + 1]))
        else:
            out.append(grams(coded[start : start + n], int(n)) if n else np.zeros(0, np.uint64))
    return out


def bin_minima(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row per set: the least hash of each bin, empty bins filled from a non-empty one.

    An empty bin probes bins in a random order of its own, the same for all
    sets, and copies the first that is not empty. An empty set keeps the mark
    of an empty bin everywhere.
    """
    out = np.full((len(sets), bins), _NONE, np.uint64)
    if not sets:
        return out
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)), sizes) * bins + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, and so are their bins
    out.reshape(-1)[cell[first]] = values[first]
    empty = out == _NONE
    row, column = np.nonzero(empty & (sizes > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix(column.astype(np.uint64) * np.uint64(0x100000001) + np.uint64(attempt << 12)) % np.uint64(bins)).astype(np.int64)
        full = ~empty[row, probe]
        out[row[full], column[full]] = out[row[full], probe[full]]
        row, column = row[~full], column[~full]
    return out


def band_rows(percent: int) -> int:
    """Bins of a band."""
    return 8 if percent >= 85 else 7


def band_keys(minima: np.ndarray, rows: int = 8) -> np.ndarray:
    bands = minima.shape[1] // rows
    minima = np.ascontiguousarray(minima[:, : bands * rows])
    keys = grams(minima.reshape(-1), rows)[::rows].reshape(-1, bands) if len(minima) else np.zeros((0, bands), np.uint64)
    return mix(keys ^ mix(np.arange(1, bands + 1)))


def _sketch(rows: int):
    def run(batches):
        for chunk in chunks(batches, "text"):
            yield _sketched(chunk, rows)

    return run


def _sketched(chunk: pa.Table, rows: int) -> pa.RecordBatch:
    sets = shingle_sets(chunk["text"])
    minima = bin_minima(sets)
    keys = band_keys(minima, rows).view(np.int64)
    digests = [struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest()) if len(s) else (None, None) for s in sets]
    return pa.RecordBatch.from_arrays(
        [
            chunk["id"].combine_chunks(), chunk["hash"].combine_chunks(),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))),
            pa.array([row.tobytes() for row in minima.astype(np.uint8)], pa.binary()),
        ],
        ["id", "hash", "n", "lo", "hi", "keys", "bins"],
    )


def _likely(percent: int):
    """Drop pairs whose bins agree far less often than those of a pair at the threshold."""

    def keep(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, BINS) for c in ("bins_u", "bins_c"))
            agree = (a == b).mean(axis=1)
            least = np.minimum(batch.column("n_u").to_numpy(), batch.column("n_c").to_numpy())
            used = BINS * -np.expm1(-least / BINS)  # bins that are not empty, expected
            goal = percent / 100
            ok = agree >= goal - 7 * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))
            yield batch.select(["u", "c"]).filter(pa.array(ok))

    return keep


def _confirm(percent: int):
    """Keep pairs whose full sets are similar enough."""

    def keep(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                packed = part.column("text_u").to_pylist() + part.column("text_c").to_pylist()
                different = {p: i for i, p in enumerate(dict.fromkeys(packed))}
                sets = shingle_sets(pa.array([unpack.decompress(p).decode() for p in different], pa.large_string()))
                ok = []
                for a, b in zip(packed[: len(part)], packed[len(part) :]):
                    a, b = sets[different[a]], sets[different[b]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(100 * both >= percent * (len(a) + len(b) - both))
                yield part.select(["u", "c"]).filter(pa.array(ok, pa.bool_()))

    return keep


def _compress(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "text"])


def _shingles(batches):
    """Every shingle of every text: id, a mark of the set, its size, the shingle."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, len(batch), 16):
            part = batch.slice(start, 16)
            sets = shingle_sets(pa.array([unpack.decompress(t).decode() for t in part.column("text").to_pylist()], pa.large_string()))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            marks = np.fromiter((np.bitwise_xor.reduce(x) for x in sets), np.uint64, len(sets)).view(np.int64)
            columns = [np.repeat(x, sizes) for x in (part.column("id").to_numpy(), marks, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*columns, np.concatenate(sets).view(np.int64))], ["id", "mark", "n", "shingle"]
            )


def remainder(left: DataFrame, texts: DataFrame, keep, percent: int) -> DataFrame:
    """Pairs (u, c) that hold all similar ones among ``left`` (id, comp) whose components differ.

    Sets are ordered by how many have a shingle. The first shingle that a
    similar pair shares stands before place ``n - overlap`` of either set, the
    least overlap being ``percent * (n + n') / (100 + percent)``. Of a shingle
    whose rows are mostly of one component, only the others meet all rows.
    """
    shingles = keep(texts.join(left, "id", "left_semi").mapInArrow(_shingles, "id long, mark long, n long, shingle long"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = shingles.join(common, "shingle").groupBy("id", "mark", "n").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("own"))
    placed = ordered.select("id", "n", (F.col("n") - F.size("own")).alias("alone"), F.posexplode("own").alias("i", "x")).select(
        "id", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), F.col("x.shingle").alias("shingle")
    ).where(100 * F.col("rest") >= percent * F.col("n"))
    sizes = left.groupBy("comp").agg(F.count("*").alias("members"))
    early = (100 + percent) * F.col("rest") >= 2 * percent * F.col("n")
    placed = keep(placed.join(left.join(sizes, "comp"), "id").withColumn("early", early))
    main = (
        placed.groupBy("shingle")
        .agg(F.max("early").alias("any"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", F.struct("members", "comp")).alias("main"))
        .where("any and low < high").select("shingle", "main")
    )
    rows = keep(placed.join(main, "shingle").select("shingle", "id", "n", "rest", "comp", "early", (F.col("comp") != F.col("main")).alias("apart")))

    def met(short: DataFrame, long: DataFrame) -> DataFrame:
        a, b = (df.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "rest", "comp"))) for df, x in ((short, "a"), (long, "b")))
        least = percent * (F.col("n_a") + F.col("n_b"))
        may = (F.col("n_a") <= F.col("n_b")) & (F.col("comp_a") != F.col("comp_b"))
        for rest in ("rest_a", "rest_b"):
            may = may & ((100 + percent) * F.col(rest) >= least)
        return a.join(b, "shingle").where(may).select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("c"))

    return met(rows.where("early and apart"), rows).union(met(rows.where("early and not apart"), rows.where("apart"))).distinct()


class _Tables:
    """Tables in the shared folder, dropped together."""

    def __init__(self, spark):
        self.spark, self.root, self.count = spark, scratch_path(spark, "near"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, keep) -> DataFrame:
    """(id, comp) of every end of ``links`` (u, c): comp is the least id that can be reached.

    Every round takes the least label of the neighbours and then the label of
    the label. ``keep`` writes a table and reads it back.
    """
    both = keep(links.select("u", "c").union(links.select(F.col("c").alias("u"), F.col("u").alias("c"))).distinct())
    labels = keep(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("c"), F.col("u")).alias("comp")))
    while True:
        near = both.join(labels, both["c"] == labels["id"]).groupBy("u").agg(F.min("comp").alias("near"))
        own = labels.join(near, labels["id"] == near["u"]).select("id", "comp", F.least("comp", "near").alias("next"))
        own = keep(own)
        jump = own.select(F.col("id").alias("at"), F.col("next").alias("further"))
        moved = keep(
            own.join(jump, own["next"] == jump["at"])
            .select("id", F.least("next", "further").alias("comp"), (F.least("next", "further") < F.col("comp")).alias("moved"))
        )
        labels = moved.select("id", "comp")
        if moved.where("moved").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, _hash (xxhash64 of the text), n_shingles, component_id, kept.

    Links hold between documents with ``100 * intersection >= percent * union``.
    """
    spark = docs.sparkSession
    tables = _Tables(spark)
    keep = tables.keep
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    facts = keep(source.mapInArrow(_sketch(band_rows(percent)), "id long, hash long, n long, lo long, hi long, keys array<long>, bins binary"))
    classes = keep(
        facts.where("lo is not null and id is not null").groupBy("lo", "hi")
        .agg(F.min(F.struct("id", "n", "keys", "bins")).alias("least")).select("lo", "hi", "least.*")
    )
    rows = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = keep(
        rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last")
        .select("key", F.col("first.id").alias("c"), F.col("first.n").alias("cn"))
    )
    members = keep(rows.join(shared, "key").select("key", "id", "n", "c", "cn"))
    narrow = classes.select("id", "n", "bins")
    wanted = keep(members.select("id").distinct())
    texts = keep(source.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(_compress, "id long, text binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        u, c = (narrow.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "uc")
        likely = keep(pairs.join(u, "u").join(c, "c").mapInArrow(_likely(percent), "u long, c long"))
        tu, tc = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uc")
        full = likely.join(tu, "u").join(tc, "c").select("u", "c", "text_u", "text_c")
        return full.mapInArrow(_confirm(percent), "u long, c long").distinct()

    alike = 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
    checked = keep(members.where((F.col("id") != F.col("c")) & alike).select(F.col("id").alias("u"), "c").distinct())
    links = keep(confirmed(checked))
    turn = 0
    while True:
        labels = components(links, keep)
        named = keep(
            members.join(labels, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        )
        mixed = keep(
            named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "id").alias("main"))
            .where("low < high").select("key", "main")
        )
        open_ = keep(named.join(mixed, "key"))
        turn += 1
        first = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(turn)), "id")
        centres = keep(
            open_.where("comp <> main").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= CENTRES)
            .select("key", F.col("id").alias("o"), F.col("n").alias("on"), F.col("comp").alias("ocomp"))
        )
        pairs = (
            open_.join(centres, "key")
            .where((F.col("comp") != F.col("ocomp")) & (100 * F.least("n", "on") >= percent * F.greatest("n", "on")))
            .select(F.greatest("id", "o").alias("u"), F.least("id", "o").alias("c")).distinct()
        )
        fresh = keep(pairs.join(checked, ["u", "c"], "left_anti"))
        more = keep(confirmed(fresh))
        if more.limit(1).count() == 0:
            break
        links, checked = keep(links.union(more)), keep(checked.union(fresh))
    untried = open_.where("comp <> main").groupBy("key").count().where(F.col("count") > CENTRES)
    left = keep(open_.join(untried, "key", "left_semi").select("id", "comp").distinct())
    if left.limit(1).count():
        more = keep(confirmed(keep(remainder(left, texts, keep, percent).join(checked.union(fresh), ["u", "c"], "left_anti"))))
        if more.limit(1).count():
            labels = components(keep(links.union(more)), keep)
    named = keep(
        classes.select("lo", "hi", "id").join(labels, "id", "left").select("lo", "hi", F.coalesce("comp", "id").alias("comp"))
    )
    plain = facts.select("id", "hash", "n", "lo", "hi")
    done = plain.join(named, ["lo", "hi"], "left").select(
        F.col("id").alias(id_col), F.col("hash").alias("_hash"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"),
    )
    path = scratch_path(spark, "near-result")
    done.write.parquet(path)
    drop_path(spark, tables.root)
    done = spark.read.schema(done.schema).parquet(path)
    return done.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
