"""Runs of marked windows of documents: packed rows, their merge, and the join to the texts.

A document is known by its id (``LAST`` for null) and the hash of its text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm.words import mix, ragged, release, runs

LAST = np.iinfo(np.int64).max
#: Texts, and characters of each, from which a compression dictionary of so many bytes is trained.
TAUGHT, TAUGHT_CHARS, DICTIONARY = 1000, 4000, 112 << 10
LEVEL = 3
COLUMNS = ("first", "second", "third")
RUNS = "id long, hash long, starts binary, sizes binary"


def dictionary_of(docs: DataFrame, rows: int, id_col: str, text_col: str) -> bytes:
    """A compression dictionary from at most ``TAUGHT`` texts, so that small blobs take no more bytes than large ones.

    Results do not depend on it; it is empty if there is too little text.
    """
    every = max(1, rows // TAUGHT)
    drawn = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(every)) == 0)
    texts = drawn.select(F.substring(text_col, 1, TAUGHT_CHARS).alias("t")).where("t is not null").limit(TAUGHT).collect()
    pieces = [piece for row in texts for piece in (row.t[i : i + 2000].encode() for i in range(0, len(row.t), 2000))]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes() if len(pieces) > 50 else b""
    except zstandard.ZstdError:
        return b""


class Codec:
    """Compression of the strings of a blob by a dictionary."""

    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_dict_id=False).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=known).decompress


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, bytes of one weight together, compressed."""
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(b"".join(planes(c) for c in columns))


def unpack_numbers(data: bytes, *lengths: int) -> list[np.ndarray]:
    planes, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for n in lengths:
        out.append(np.ascontiguousarray(planes[at : at + 8 * n].reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * n
    return out


def planes(table: np.ndarray) -> bytes:
    """The bytes of a column of whole numbers, or of the columns of a table one after another, those of one weight together."""
    return np.ascontiguousarray(table, "<i8").view(np.uint8).reshape(len(table), math.prod(table.shape[1:]) * 8).T.tobytes()


def unpacked(data: np.ndarray, columns: int) -> np.ndarray:
    """The columns of a table from the bytes of its planes."""
    # always a copy: the planes of one row are in place already, and cannot be written to
    return np.array(data.reshape(columns, 8, -1).transpose(0, 2, 1), order="C").view("<i8")[:, :, 0]


def steps(sorted_: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first number included; their running sum gives the numbers back."""
    return np.concatenate((sorted_[:1], np.diff(sorted_)))


def first_of_each(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which rows are the first with their id and hash."""
    order = np.lexsort((np.arange(len(ids)), hashes, ids))
    new = np.ones(len(ids), bool)
    new[order[1:]] = (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)
    return new


def joined_runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs of consecutive ones: document, first window, number of windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first, size = runs(start, doc)
    return doc[first], start[first], size


def pack_runs(ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, parts: int):
    """Rows (part, documents, first, second, third), one for each part that has runs.

    ``first`` holds id, hash and number of runs of each document, the others
    the runs' first windows and sizes.
    """
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    d, s, n = doc[order], start[order], size[order]
    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
    count, docs = np.diff(np.concatenate((cut, [len(d)]))), d[cut]
    # by id too: copies of one text spread over all parts
    part = (mix(ids[docs].astype(np.int64).view(np.uint64) ^ mix(hashes[docs].view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        own = order[a:b]
        at = ragged(cut[own], count[own])
        head = np.stack([ids[docs[own]], hashes[docs[own]], count[own]]).astype("<i8")
        yield int(part[own[0]]), len(own), head.tobytes(), s[at].astype("<i4").tobytes(), n[at].astype("<i4").tobytes()


def merge_runs(key, table):
    """One row for each document of a part."""
    heads = [np.frombuffer(x, "<i8").reshape(3, -1) for x in table["first"].to_pylist()]
    ids, hashes, count = np.concatenate(heads, axis=1)
    starts, sizes = (np.concatenate([np.frombuffer(x, "<i4") for x in table[c].to_pylist()]) for c in ("second", "third"))
    begin = np.cumsum(count) - count
    order = np.lexsort((ids, hashes))
    edges = np.flatnonzero(np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0))))
    rows = []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        own = order[a:b]
        at = ragged(begin[own], count[own])
        rows.append((ids[own[0]], hashes[own[0]], starts[at].tobytes(), sizes[at].tobytes()))
    columns = list(zip(*rows))
    return pa.table({
        "id": pa.array(columns[0], pa.int64()), "hash": pa.array(columns[1], pa.int64()),
        "starts": pa.array(columns[2], pa.binary()), "sizes": pa.array(columns[3], pa.binary()),
    })


def covered(n: int, starts: bytes | None, sizes: bytes | None, window: int) -> np.ndarray:
    """Which of ``n`` places lie in a marked window."""
    edge = np.zeros(n + 1, np.int32)
    if starts is not None:
        s, m = np.frombuffer(starts, "<i4"), np.frombuffer(sizes, "<i4")
        np.add.at(edge, s, 1)
        np.add.at(edge, s + m + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def with_runs(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, schema: str, judge) -> DataFrame:
    """All rows and columns of ``docs`` and those that ``judge(text bytes, starts, sizes)`` adds.

    Texts are compressed before the shuffle of the join. ``judge`` returns one
    tuple a row, in the order of ``schema``. The caller's columns travel by
    place, whatever their names; one that has the name of an added column is
    left out.
    """
    names = docs.columns
    kinds = {"string": (T.StringType(), pa.string()), "long": (T.LongType(), pa.int64()), "binary": (T.BinaryType(), pa.binary())}
    added = [(name, *kinds[kind]) for name, kind in (part.split() for part in schema.split(","))]
    new = [name for name, _, _ in added]
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.col(f"c{names.index(text_col)}")
    keyed = plain.select(
        F.struct(*(f"c{i}" for i, name in enumerate(names) if name != text_col)).alias("row"),
        F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"),
    )
    row = keyed.schema["row"]

    def shrink(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                zipped = pa.array([None if t is None else pack.compress(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "hash")), zipped], ["row", "id", "hash", "zip"])
        release()

    zipped = keyed.mapInArrow(
        shrink, T.StructType([row, T.StructField("id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("zip", T.BinaryType())])
    )
    joined = zipped.join(marks, ["id", "hash"], "left")

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [None if z is None else unpack.decompress(z) for z in part.column("zip").to_pylist()]
                rows = [judge(t or b"", s, m) for t, s, m in zip(texts, part.column("starts").to_pylist(), part.column("sizes").to_pylist())]
                made = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*rows), added)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), *made],
                    ["row", "text", *(f"n{i}" for i in range(len(made)))],
                )
        release()

    done = joined.select("row", "zip", "starts", "sizes").mapInArrow(
        finish, T.StructType([row, T.StructField("text", T.StringType()), *(T.StructField(f"n{i}", kind) for i, (_, kind, _) in enumerate(added))])
    )
    kept = [(i, name) for i, name in enumerate(names) if name not in new]
    back = [F.col("text").alias(f"c{i}") if name == text_col else F.col(f"row.c{i}").alias(f"c{i}") for i, name in kept]
    return done.select(*back, *(f"n{i}" for i in range(len(new)))).toDF(*(name for _, name in kept), *new)
