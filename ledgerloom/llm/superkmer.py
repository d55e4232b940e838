"""Substring dedup by super-k-mers of words.

A window is 13 consecutive words of one document; a word goes if a window that
covers it also starts in a document with a smaller id.

1. Every map task sorts its own windows. A window that a document with a
   smaller id in the same task also has is marked there and not sent, so a
   passage that any share of all documents holds leaves each task once.
2. The minimiser of a window is the least hash of its three-word grams.
   Consecutive windows with the same minimiser travel as one packed string to
   the bucket of the minimiser; a compressed blob holds those of one chunk of a
   task for one bucket, by a dictionary trained on a bounded sample of texts, so
   that the bytes sent hardly depend on the number of buckets.
3. In its bucket every window meets all its equals. Sorting brings them
   together; equal hashes are confirmed word by word.
4. Marks are joined to the documents by id and text hash.

Cases: a null text has no words; a null id counts as larger than any other, and
rows without id do not mark one another; rows with the same id do not mark one
another, whatever their texts; repeated rows get the same result each; a text
of fewer than 13 words loses nothing; other columns are untouched, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.spans import (
    COLUMNS, LAST, RUNS, Codec, covered, dictionary_of, first_of_each, joined_runs, merge_runs, pack_numbers, pack_runs, steps, unpack_numbers, with_runs,
)
from ledgerloom.llm.words import chunks, grams, hash_strings, mix, ragged, release, runs, sliding_min, split_words, whole

WINDOW = 13
GRAM = 3
#: Text bytes whose windows one bucket takes on average.
BUCKET_BYTES = 8 << 20
CHUNK = 8 << 20
_BLOB = "bucket int, kind int, id long, hash long, first binary, second binary, third binary"


def _pack_words(spaced: pa.Array, ids: np.ndarray, codec: Codec) -> bytes:
    """The words, a space after each, compressed."""
    words = spaced.take(pa.array(ids))
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return codec.pack(memoryview(words.buffers()[2] or b"")[ends[0] : ends[-1]])


def _unpack_words(packed: bytes, codec: Codec) -> pa.Array:
    """The words, each with its space."""
    text = codec.unpack(packed)
    ends = np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20) + 1)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)])


def _marked(hashes: np.ndarray, owner: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which windows equal one of an owner with a smaller value.

    ``at`` are the places of the windows' first words in ``ids``.
    """
    order = np.lexsort((owner, hashes))
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else new
    later = np.flatnonzero(owner[order] != owner[order[head]]) if len(h) else np.zeros(0, np.int64)
    me, him = order[later], order[head[later]]
    same = np.ones(len(later), bool)
    for j in range(window):
        same &= ids[at[me] + j] == ids[at[him] + j]
    marked = np.zeros(len(hashes), bool)
    marked[me[same]] = True
    if not same.all():  # two windows with one hash: settle these groups by their words
        for value in np.unique(hashes[me[~same]]):
            least: dict[bytes, int] = {}
            group = np.flatnonzero(hashes == value)
            keys = [ids[at[i] : at[i] + window].tobytes() for i in group]
            for key, i in zip(keys, group):
                least[key] = min(least.get(key, owner[i]), owner[i])
            marked[group] = [owner[i] > least[key] for key, i in zip(keys, group)]
    return marked


def _cutter(buckets: int, window: int, gram: int, dictionary: bytes = b""):
    def cut(batches):
        codec = Codec(dictionary)
        for chunk in chunks(batches, "_text", CHUNK):
            ids = chunk["_id"].fill_null(LAST).to_numpy()
            order = np.argsort(ids, kind="stable")
            # rows that repeat id and text get the same marks: one of them stands for all
            order = order[first_of_each(ids, chunk["_hash"].to_numpy())[order]]
            chunk, ids = chunk.take(pa.array(order)), ids[order]
            hashes = chunk["_hash"].to_numpy()
            words = split_words(chunk["_text"])
            starts, owner = words.starts, words.owner
            coded = hash_strings(words.vocabulary)[words.ids]
            at = np.flatnonzero(whole(words.counts, window))
            own_hash = grams(coded, window)[at]
            marked = _marked(own_hash, ids[owner[at]], at, words.ids, window)
            hit = owner[at[marked]]
            packed = pack_runs(ids, hashes, *joined_runs(hit, at[marked] - starts[hit]), buckets)
            out = [(part, 0, n, None, *rest) for part, n, *rest in packed]
            least = sliding_min(grams(coded, gram), window - gram + 1)
            sent = at[~marked]
            first, size = runs(sent, least[sent], owner[sent])
            begin = sent[first]
            doc = owner[begin]
            bucket = (mix(least[begin]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            begin, size, doc, bucket = begin[order], size[order], doc[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            del own_hash, least, sent, at, coded, owner
            spaced = pc.binary_join_element_wise(words.vocabulary.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                text = _pack_words(spaced, words.ids[ragged(begin[a:b], size[a:b] + window - 1)], codec)
                docs, inside = np.unique(doc[a:b], return_inverse=True)
                table = pack_numbers(steps(ids[docs]), steps(inside), begin[a:b] - starts[doc[a:b]], size[a:b])
                out.append((int(bucket[a]), 1, len(docs), b - a, text, hashes[docs].astype("<i8").tobytes(), table))
            for a in range(0, len(out), 2000):
                columns = list(zip(*out[a : a + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "kind", "id", "hash", "first", "second", "third"],
                )

    return cut


def _bucket_marks(window: int, parts: int, dictionary: bytes = b""):
    def count(table):
        release()
        codec = Codec(dictionary)
        ids, hashes, strings, tables = [], [], [], []
        docs = 0
        for n_docs, n_runs, text, head, rest in zip(*(table[c].to_pylist() for c in ("id", "hash", "first", "second", "third"))):
            own, inside, start, size = unpack_numbers(rest, n_docs, n_runs, n_runs, n_runs)
            ids.append(np.cumsum(own))
            hashes.append(np.frombuffer(head, "<i8"))
            tables.append(np.stack([np.cumsum(inside) + docs, start, size]))
            strings.append(_unpack_words(text, codec))
            docs += n_docs
        ids, hashes, (doc, start, size) = np.concatenate(ids), np.concatenate(hashes), np.concatenate(tables, axis=1)
        coded = pa.concat_arrays(strings).dictionary_encode()
        del strings
        flat = coded.indices.to_numpy()
        begin = np.cumsum(size + window - 1) - (size + window - 1)
        at = ragged(begin, size)
        run = np.repeat(np.arange(len(size)), size)
        own_hash = grams(hash_strings(coded.dictionary)[flat], window)[at]
        marked = np.flatnonzero(_marked(own_hash, ids[doc[run]], at, flat, window))
        hit = run[marked]
        rows = list(pack_runs(ids, hashes, *joined_runs(doc[hit], start[hit] + at[marked] - begin[hit]), parts))
        columns = list(zip(*rows)) or [(), (), (), (), ()]
        return pa.table({
            name: pa.array(column, kind)
            for name, column, kind in zip(("part", "n", *COLUMNS), columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))
        })

    return count


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Marks (id, hash of the text, starts, sizes): runs of windows that also start in a document with a smaller id.

    ``starts`` and ``sizes`` are little-endian 32-bit arrays; documents without
    marks have no row.
    """
    total, rows = docs.select(F.sum(F.octet_length(text_col)), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / BUCKET_BYTES))
    dictionary = dictionary_of(docs, rows, id_col, text_col)
    cut = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")
    ).mapInArrow(_cutter(buckets, window, GRAM, dictionary), _BLOB)
    count = _bucket_marks(window, buckets, dictionary)

    def marks(key, table):
        if key[1].as_py():
            return count(table)
        return table.select(["bucket", "id", *COLUMNS]).rename_columns(["part", "n", *COLUMNS])

    # marks made before the shuffle pass through it in groups of their own
    packed = cut.groupBy("bucket", "kind").applyInArrow(marks, "part int, n long, first binary, second binary, third binary")
    return packed.groupBy("part").applyInArrow(merge_runs, RUNS)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns, with two more: ``_kept`` (kept words joined by one space) and ``_removed`` (how many went).

    ``_words`` is the number of words.
    """

    def judge(text: bytes, starts, sizes):
        words = text.split()
        n = len(words)
        if starts is not None:
            words = list(itertools.compress(words, ~covered(n, starts, sizes, window)))
        return b" ".join(words).decode(), n, n - len(words)

    marks = repeated_windows(docs, id_col, text_col, window)
    return with_runs(docs, marks, id_col, text_col, "_kept string, _words long, _removed long", judge)
