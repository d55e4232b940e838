"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors become whole numbers, floor(256 x). The index cuts them into blocks. A
block's postings (dimension, vector, value) are put in segments by quantised
impact, a quarter of a power of two of the value's size and its sign, and the
segments are stored by descending impact. Beside each level of impact the index keeps, for
every vector, the length of what has not been read yet.

A block's segments are read in that order into a matrix of impacts, whose
product with a pack of queries is their accumulators. After a level, a vector's
score lies within length of the query times length of what is unread or lost by
quantising (Cauchy-Schwarz) of its accumulator. A vector whose upper bound is
below the k-th largest score known of the query, or below the k-th largest lower
bound, cannot be a member. Reading stops when this proof leaves few possible
members; those, ties included, are scored again exactly from the stored vectors.
Where the proof never comes, the last level ends the reading. Accumulators are
of single precision; what they may be off by is part of the bounds.

A task holds one stripe of the queries, packed, and reads a piece of the index
block by block; it returns k rows a query. Queries go to every piece and the
index to every stripe, and there is one stripe unless the queries take more than
``HELD`` bytes. No join makes pairs of rows.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part, as query or candidate; vectors of other lengths than the query's are
no candidates; ties go to the smaller id; repeated ids are candidates each; a
query is never its own candidate, nor are rows that repeat its id; null ids
take no part; other columns are ignored; an empty table gives no rows. Values
must fit sums of 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.spans import pack_numbers, steps, unpack_numbers
from ledgerloom.session import scratch_path, small_batches

BLOCK = 4096
QUERY_BLOCK = 256
#: Blocks of a piece of a large index.
PIECE = 64
#: Bytes of the queries that a task holds, with their best rows.
HELD = 96 << 20
#: Rows whose lower bounds stand in for a score that is not known yet, and pairs scored at once.
SEED, PAIRS = 1024, 1 << 14
#: Reading stops when this share of a block's vectors at most is still possible.
POSSIBLE = 0.02


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level (larger for larger sizes) and impact (middle of the level, signed) of whole numbers.

    Every power of two has four levels.
    """
    size = np.abs(values).astype(np.float64)
    part, power = np.frexp(size)
    quarter = np.floor(8 * part)  # 4 to 7
    level = np.where(size > 0, 4 * power + quarter - 3, 0).astype(np.int64)
    impact = np.where(size > 0, np.sign(values) * np.ldexp((quarter + 0.5) / 8, power), 0.0)
    return level, impact


def build_index(matrix: np.ndarray) -> tuple[list, np.ndarray]:
    """Segments (level, dimension, impact, vectors) by descending impact, and unread lengths by level."""
    level, impact = quantise(matrix)
    vector, dimension = np.nonzero(level)
    order = np.lexsort((matrix[vector, dimension] < 0, dimension, -level[vector, dimension]))
    vector, dimension = vector[order], dimension[order]
    at, size, value = level[vector, dimension], impact[vector, dimension], matrix[vector, dimension].astype(np.float64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(dimension) != 0) | (np.diff(size) != 0)
    first = np.flatnonzero(new)
    parts = np.split(vector.astype(np.int32), first[1:])
    segments = [(int(at[f]), int(dimension[f]), float(size[f]), own) for f, own in zip(first, parts)]
    rest = (matrix.astype(np.float64) ** 2).sum(axis=1)
    unread = [np.sqrt(rest)]
    won = value**2 - (value - size) ** 2
    ends = np.flatnonzero(np.diff(at, append=-1))
    for a, b in zip([0, *(ends[:-1] + 1)], ends + 1):
        rest = rest - np.bincount(vector[a:b], won[a:b], len(matrix))
        unread.append(np.sqrt(np.maximum(rest, 0)))
    return segments, np.array(unread)


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The numbers in the least whole type that holds them."""
    least, most = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    return matrix.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _places(flags: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of flags of which few are set: by eights first."""
    flat = flags.ravel()
    whole = len(flat) // 8 * 8
    near = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate((near[flat[near]], whole + np.flatnonzero(flat[whole:])))


class Pack:
    """Queries and the k best rows that each has met, best first; a row of -1 is a free place."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        self.lengths = np.where(lengths > 0, lengths, 1.0)
        self.scores, self.ids = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k), np.int64)
        self.rows = np.full((len(queries), k), -1, np.int64)

    def settle(self, read: np.ndarray, slack: np.ndarray, matrix: np.ndarray, ids: np.ndarray, first_row: int, last: bool) -> bool:
        """Take up the members that a block may have; False if these are too many for now.

        ``read`` has impacts by dimension and, below, ``slack``, which is for a query of length one.
        """
        n = len(ids)
        unit = np.ones((len(self.queries), len(read)), np.float32)
        unit[:, :-1] = self.queries / self.lengths[:, None]
        upper = unit @ read
        full = self.rows[:, -1] >= 0
        # twice the next smaller number: the division and the narrowing both round
        bar = np.where(full, self.scores[:, -1] / self.lengths, -np.inf).astype(np.float32)
        bar = np.nextafter(np.nextafter(bar, np.float32(-np.inf)), np.float32(-np.inf))
        seeds = min(n, SEED)
        if seeds > self.k and not full.all():
            lower = upper[:, :seeds] - 2 * slack[:seeds]
            lower[self.query_ids[:, None] == ids[None, :seeds]] = -np.inf
            bar = np.maximum(bar, np.partition(lower, seeds - self.k, axis=1)[:, seeds - self.k])
        hit = _places(upper >= bar[:, None])
        if not last and len(hit) > max(POSSIBLE * upper.size, 4 * self.k * len(self.queries)):
            return False
        of, at = np.divmod(hit, n)
        other = ids[at] != self.query_ids[of]
        of, at = of[other], at[other]
        for i in range(0, len(of), PAIRS):
            q, r = of[i : i + PAIRS], at[i : i + PAIRS]
            scores = np.einsum("ij,ij->i", matrix[r].astype(np.int64), self.queries[q].astype(np.int64))
            self._add(q, scores, ids[r], first_row + r)
        return True

    def _add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        worst = self.scores[q, -1]
        better = (self.rows[q, -1] < 0) | (scores > worst) | ((scores == worst) & (ids < self.ids[q, -1]))
        if not better.any():
            return
        own = np.unique(q[better])
        q = np.concatenate((np.repeat(own, self.k), q[better]))
        scores, ids, rows = (
            np.concatenate((held[own].ravel(), x[better])) for held, x in ((self.scores, scores), (self.ids, ids), (self.rows, rows))
        )
        order = np.lexsort((ids, ~scores, rows < 0, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.scores[q, place], self.ids[q, place], self.rows[q, place] = scores[order], ids[order], rows[order]


def scan_block(segments: list, unread: np.ndarray, matrix: np.ndarray, ids: np.ndarray, packs: list[Pack], first_row: int = 0, share: float = 1.0) -> float:
    """Packs meet a block. The first proof is tried at ``share`` of the lengths unread; returns where the last one was."""
    n, width = matrix.shape
    if not n:
        return share
    read = np.zeros((width + 1, n), np.float32)
    left = unread.mean(axis=1)
    # covers the rounding of the accumulators, and of the unread lengths
    rounding = 4 * (width + 8) * 2.0**-24 * unread[0]
    waiting, at, step, due = packs, 0, 0, share * left[0] * (1 + 1e-9)
    while True:
        last = at == len(segments) or n <= packs[0].k
        if last or left[step] <= due:
            due = 0.7 * left[step]  # later proofs are tried when enough was read since
            share = min(share, left[step] / left[0]) if left[0] else share
            slack = read[width] = (unread[step] + rounding).astype(np.float32)
            waiting = [p for p in waiting if not p.settle(read, slack, matrix, ids, first_row, last)]
            if not waiting:
                return share
        level, step = segments[at][0], step + 1
        while at < len(segments) and segments[at][0] == level:
            _, dimension, impact, vectors = segments[at]
            read[dimension, vectors] = impact
            at += 1


def search_block(segments: list, unread: np.ndarray, matrix: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """Per query: indices of the k best rows and their scores."""
    pack = Pack(queries, query_ids, k)
    scan_block(segments, unread, matrix, ids, [pack])
    for rows, scores in zip(pack.rows, pack.scores):
        yield rows[rows >= 0], scores[rows >= 0]


def _numbers(vector: str, scale: int):
    """Whole numbers of a vector column; null unless all components are finite."""
    x = F.col(vector)
    value = lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))
    unsound = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~unsound, F.transform(x, value))


def _index_rows():
    def build(key, table):
        width = key[1].as_py()
        ids = table["id"].to_numpy()
        matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        segments, unread = build_index(matrix)
        levels, dimensions, impacts, parts = zip(*segments) if segments else ((), (), (), ())
        # unread lengths as parts of the whole ones, in 255ths, rounded up
        share = np.ceil(255 * np.divide(unread, unread[0], out=np.ones_like(unread), where=unread[0] > 0))
        row = {
            "ids": pack_numbers(steps(ids)), "vectors": pack_numbers(matrix.ravel()),
            "head": pack_numbers(steps(np.array(levels, np.int64)), np.array(dimensions, np.int64)),
            "impacts": np.array(impacts, "<f8").tobytes(), "sizes": pack_numbers(np.array([len(p) for p in parts], np.int64)),
            "postings": pack_numbers(steps(np.concatenate(parts).astype(np.int64)) if parts else np.zeros(0, np.int64)),
            "lengths": unread[0].astype("<f8").tobytes(), "unread": np.clip(share, 0, 255).astype(np.uint8).tobytes(),
        }
        return pa.table({
            "block": [key[0].as_py()], "width": pa.array([width], pa.int32()), "n": pa.array([len(ids)], pa.int64()),
            "segments": pa.array([len(segments)], pa.int64()), "entries": pa.array([sum(map(len, parts))], pa.int64()),
            **{name: pa.array([x], pa.binary()) for name, x in row.items()},
        })

    return build


_BLOBS = ("ids", "vectors", "head", "impacts", "sizes", "postings", "lengths", "unread")
_INDEX = "block long, width int, n long, segments long, entries long, " + ", ".join(f"{name} binary" for name in _BLOBS)


def _index_block(row: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, unread lengths, vectors and ids of a stored row."""
    n, width, count = row["n"], row["width"], row["segments"]
    ids = np.cumsum(unpack_numbers(row["ids"], n)[0])
    matrix = unpack_numbers(row["vectors"], n * width)[0].reshape(n, width)
    levels, dimensions = unpack_numbers(row["head"], count, count)
    postings = np.cumsum(unpack_numbers(row["postings"], row["entries"])[0])
    parts = np.split(postings, np.cumsum(unpack_numbers(row["sizes"], count)[0])[:-1])
    segments = list(zip(np.cumsum(levels).tolist(), dimensions.tolist(), np.frombuffer(row["impacts"], "<f8").tolist(), parts))
    lengths = np.frombuffer(row["lengths"], "<f8")
    return segments, np.frombuffer(row["unread"], np.uint8).reshape(-1, n) / 255 * lengths, matrix, ids


def write_index(vectors: DataFrame, path: str, id_col: str, vector_col: str, scale: int = 256, block: int = BLOCK) -> None:
    """Index every sound row below ``path``: whole vectors, and one row of segments per block."""
    spark = vectors.sparkSession
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), _numbers(vector_col, scale).alias("v")).where("id is not null and v is not null")
    sound.withColumn("width", F.size("v")).write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    blocks = max(1, math.ceil(stored.count() / block))
    stored.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).groupBy("block", "width").applyInArrow(
        _index_rows(), _INDEX
    ).write.parquet(f"{path}/blocks")


def _pack_queries(key, table):
    width = key[1].as_py()
    ids, numbers = table["id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy()
    return pa.table({
        "qblock": [key[0].as_py()], "width": pa.array([width], pa.int32()), "n": pa.array([len(ids)], pa.int64()),
        "bytes": pa.array([_narrow(numbers).nbytes], pa.int64()),
        "ids": pa.array([pack_numbers(ids)], pa.binary()), "vectors": pa.array([pack_numbers(numbers)], pa.binary()),
    })


def _meet(k: int):
    def answers(packs):
        for pack in (p for own in packs.values() for p in own):
            query, place = np.nonzero(pack.rows >= 0)
            columns = (pack.query_ids[query], pack.ids[query, place], pack.scores[query, place])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "id", "score"])

    def search(batches):
        cell, packs, share = None, {}, {}
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from answers(packs)
                    cell, packs, share = row["cell"], {}, {}
                width, n = row["width"], row["n"]
                if not row["kind"]:
                    queries = _narrow(unpack_numbers(row["vectors"], n * width)[0].reshape(n, width))
                    packs.setdefault(width, []).append(Pack(queries, unpack_numbers(row["ids"], n)[0], k))
                elif width in packs:
                    share[width] = scan_block(*_index_block(row), packs[width], share=share.get(width, 1.0))
        yield from answers(packs)

    return search


def search(spark, path: str, k: int = 5, every: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of each query; queries are rows whose id ``every`` divides."""
    small_batches(spark)
    stored = spark.read.parquet(f"{path}/vectors")
    asked = stored.where(F.col("id") % every == 0)
    qblocks = max(1, math.ceil(asked.count() / query_block))
    asked.withColumn("qblock", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(qblocks))).groupBy("qblock", "width").applyInArrow(
        _pack_queries, "qblock long, width int, n long, bytes long, ids binary, vectors binary"
    ).write.parquet(f"{path}/queries")
    packed, index = spark.read.parquet(f"{path}/queries"), spark.read.parquet(f"{path}/blocks")
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    held = packed.agg(F.sum(F.col("bytes") + F.col("n") * (24 * k + 16))).first()[0] or 0
    stripes = min(qblocks, max(1, math.ceil(held / HELD)))
    pieces = min(blocks, max(math.ceil(blocks / PIECE), 2 * spark.sparkContext.defaultParallelism))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = packed.select("width", "n", "ids", "vectors", "qblock", every_one(pieces).alias("piece")).withColumn("stripe", F.pmod("qblock", F.lit(stripes)))
    told = index.select("*", every_one(stripes).alias("stripe")).withColumn("piece", F.pmod("block", F.lit(pieces)))
    cell = (F.col("stripe") * pieces + F.col("piece")).cast("int").alias("cell")
    asks, told = (df.select(cell, F.lit(kind).alias("kind"), *(c for c in df.columns if c not in ("block", "qblock", "stripe", "piece"))) for kind, df in ((0, asks), (1, told)))
    # a task gets the queries of its cell, then the blocks
    dealt = asks.unionByName(told, allowMissingColumns=True).repartitionById(stripes * pieces, "cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(_meet(k), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Index all rows and search them."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "impact")
    write_index(vectors, path, id_col, vector_col, scale)
    return search(spark, path, k, every).withColumnRenamed("id", id_col)
