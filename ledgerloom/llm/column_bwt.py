"""Byte dedup by suffix orders of many short strings, built column by column.

A byte goes if a 200-byte string that covers it also starts anywhere else.

1. The anchor of a window of 200 bytes is its first 32-byte gram of least hash.
   Equal windows have equal anchors at equal distances, so consecutive windows
   with one anchor travel as one string to the bucket of the anchor. Equal
   strings of a chunk are sent once, with a note that there were several. Strings
   are compressed by a dictionary trained on a bounded sample of texts.
2. In its bucket, strings that occur twice are repeated as a whole. Different
   strings with one anchor form a collection, laid out so that their anchors
   stand in one column. Each round inserts one symbol of every string, right to
   left: the files of the suffix order and of the common prefixes are read in
   sequence, the symbols before the suffixes, in this order, are the transform
   of the column, and sorting it stably gives the next order. The common prefix
   of two suffixes with one symbol is one more than the least since that symbol
   last came; both files are written anew. Prefixes are counted up to 200.
   Windows of other columns cannot be equal, so a round keeps the suffixes that
   start in its own column and drops those of the column before.
3. A suffix with a neighbour that shares 200 bytes starts a repeated window.

Memory is that of one bucket, its strings being at most 368 bytes long; the
files live in a temporary folder of the task and go with it. A collection of at
most ``BLOCK_ROWS`` strings needs no files.

Cases: a null text is empty; texts under 200 bytes lose nothing; null ids and
repeated ids are documents like others, and repeated rows repeat each other;
other columns are untouched, whatever their names; an empty table gives no rows.
Removed runs may cut characters, so what is kept is bytes. A text above a
gibibyte raises; the cutter takes some sixty bytes for each byte of a text.
"""

from __future__ import annotations

import contextlib
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.spans import (
    COLUMNS, LAST, RUNS, Codec, covered, dictionary_of, first_of_each, merge_runs, pack_runs, planes, unpacked, with_runs,
)
from ledgerloom.llm.words import chunks, mix, ragged, release, runs, sliding_min

WIDTH = 200
GRAM = 32
CHUNK = 4 << 20
BUCKET_BYTES = 6 << 20
BLOCK_ROWS = 4 << 20
_PLACE = (1 << 30) - 1
_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_PIECES = "bucket int, kind int, n long, first binary, second binary, third binary"


def byte_grams(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hash of every ``width`` bytes (a power of two), at the place of the first."""
    out, have = _CODES[data], 1
    with np.errstate(over="ignore"):
        while have < width:
            left = out[: max(len(out) - have, 0)] * np.uint64(0x9E3779B97F4A7C15 + 2 * have)
            out = left + out[have:] if len(out) > have else out[:0]
            have *= 2
    return mix(out)


class _Files:
    """The strings in the order of their suffixes, and the common prefixes of neighbours, read and written in sequence.

    Up to ``BLOCK_ROWS`` rows stay in memory: opening files for every column takes longer than the rest.
    """

    def __init__(self, folder: str):
        self.folder, self.turn, self.rows, self.held = folder, 0, 0, ()

    def _open(self, name: str, turn: int, mode: str):
        return open(os.path.join(self.folder, f"{name}.{turn % 2}"), mode)

    def blocks(self):
        """(start, strings, prefixes) of consecutive rows."""
        if not self.rows:
            return
        if self.rows <= BLOCK_ROWS:
            yield 0, *self.held
            return
        with self._open("order", self.turn, "rb") as order, self._open("prefix", self.turn, "rb") as prefix:
            for start in range(0, self.rows, BLOCK_ROWS):
                yield start, np.fromfile(order, np.int32, BLOCK_ROWS), np.fromfile(prefix, np.uint8, BLOCK_ROWS)

    def write(self, parts) -> None:
        waiting, length, rows, files = [], 0, 0, ()
        with contextlib.ExitStack() as opened:
            for strings, prefixes in parts:
                waiting.append((strings.astype(np.int32), prefixes.astype(np.uint8)))
                length, rows = length + len(strings), rows + len(strings)
                if length > BLOCK_ROWS:
                    files = files or [opened.enter_context(self._open(name, self.turn + 1, "wb")) for name in ("order", "prefix")]
                    self._put(files, waiting)
                    waiting, length = [], 0
            if files:
                self._put(files, waiting)
        self.held = () if files or not rows else waiting[0] if len(waiting) == 1 else tuple(map(np.concatenate, zip(*waiting)))
        self.turn, self.rows = self.turn + 1, rows

    @staticmethod
    def _put(files, waiting: list) -> None:
        for file, parts in zip(files, zip(*waiting)):
            np.concatenate(parts).tofile(file)


class _Column:
    """One round: takes blocks of the old order and holds the new one by symbol."""

    def __init__(self, cap: int):
        self.cap, self.parts = cap, []
        self.least, self.seen = np.full(256, 255, np.uint8), np.zeros(256, bool)

    def add(self, strings: np.ndarray, prefixes: np.ndarray, symbols: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        count = np.bincount(symbols, minlength=256)
        here = count > 0
        end = np.cumsum(count)[here]
        begin = end - count[here]
        c = symbols[order]
        # least prefix between a row and the row before it that has its symbol
        low = np.empty(len(order), np.int64)
        low[1:] = order[:-1] + 1
        low[begin] = 0
        group = np.repeat(np.arange(len(end)), count[here])
        edges = np.zeros(len(order) + len(end), np.int64)
        edges[np.arange(len(order)) + group] = low
        edges[end + np.arange(len(end))] = order[end - 1] + 1
        smallest = np.minimum.reduceat(np.append(prefixes, np.uint8(255)), edges)[np.arange(len(order)) + group]
        smallest[begin] = np.minimum(smallest[begin], self.least[here])
        value = np.minimum(smallest.astype(np.int64) + 1, self.cap)
        value[begin[~self.seen[here]]] = 0
        from_here = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(255))
        self.least = np.minimum(self.least, from_here[0])
        self.least[here] = from_here[order[end - 1] + 1]
        self.seen |= here
        self.parts.append((strings[order], value, np.concatenate(([0], np.cumsum(count)))))

    def sorted(self):
        if len(self.parts) == 1:
            yield self.parts[0][:2]
            return
        for c in np.flatnonzero(self.seen):
            for strings, prefixes, at in self.parts:
                if at[c + 1] > at[c]:
                    yield strings[at[c] : at[c + 1]], prefixes[at[c] : at[c + 1]]


def _joined(new: np.ndarray, blocks):
    """Blocks of rows; the empty suffixes of strings that end here come first and share nothing."""
    for at, strings, prefixes in blocks:
        if at == 0 and len(new):
            strings, prefixes = np.concatenate((new, strings)), np.concatenate((np.zeros(len(new), np.uint8), prefixes))
            prefixes[len(new)] = 0
            new = new[:0]
        yield strings, prefixes
    if len(new):
        yield new, np.zeros(len(new), np.uint8)


def _without(blocks, leaves: np.ndarray):
    """The rows whose string does not leave; a prefix becomes the least of those it now spans."""
    carry = 255
    for _, strings, prefixes in blocks:
        stay = np.flatnonzero(~leaves[strings])
        if len(stay):
            spans = np.minimum.reduceat(prefixes[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
            spans[0] = min(spans[0], carry)
            tail = prefixes[stay[-1] + 1 :]
            carry = int(tail.min(initial=255))
            yield strings[stay], spans
        else:
            carry = min(carry, int(prefixes.min(initial=255)))


def repeated_starts(data: np.ndarray, begin: np.ndarray, length: np.ndarray, before: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which windows of a collection of strings occur twice at the same distance from the anchors.

    ``before`` is where in each string its anchor stands. The flags of string i
    are those of its windows, in order; strings follow one another.
    """
    windows = np.maximum(length - width + 1, 0)
    base = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    if not len(begin):
        return out
    right, left = length - before - 1, -before  # columns of the last and the first symbol
    entering = np.argsort(-right, kind="stable")
    right_sorted = -right[entering]
    leaving = np.bincount(left - left.min()) > 0
    anchors = begin + before
    with tempfile.TemporaryDirectory() as folder:
        files = _Files(folder)
        for column in range(int(right.max()), int(left.min()) - 1, -1):
            a, b = np.searchsorted(right_sorted, (-column, -column + 1))
            round_ = _Column(width)
            for strings, prefixes in _joined(entering[a:b].astype(np.int32), files.blocks()):
                round_.add(strings, prefixes, data[anchors[strings] + column])
            files.write(round_.sorted())
            last = None
            for _, strings, prefixes in files.blocks():
                shared = prefixes >= width
                hit = shared.copy()
                hit[:-1] |= shared[1:]
                if last is not None and shared[0]:
                    _flag(out, base, windows, before, last, column)
                _flag(out, base, windows, before, strings[hit], column)
                last = strings[-1:]
            if column - left.min() < len(leaving) and leaving[column - left.min()]:
                files.write(_without(files.blocks(), left == column))
    return out


def _flag(out: np.ndarray, base: np.ndarray, windows: np.ndarray, before: np.ndarray, strings: np.ndarray, column: int) -> None:
    nth = before[strings] + column
    real = nth < windows[strings]
    out[(base[strings] + nth)[real]] = True


def _digests(data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    view = memoryview(data)
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(view[a : a + n]) for a, n in zip(begin.tolist(), length.tolist())])
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each group begins in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _cutter(buckets: int, width: int, dictionary: bytes = b""):
    def cut(batches):
        codec, numbers_of = Codec(dictionary), zstandard.ZstdCompressor(level=3, write_checksum=False)
        for chunk in chunks(batches, "_text", CHUNK):
            ids, hashes = chunk["_id"].fill_null(int(LAST)).to_numpy(), chunk["_hash"].to_numpy()
            texts = pc.fill_null(chunk["_text"].combine_chunks().cast(pa.large_binary()), b"")
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
            if len(raw) > _PLACE:
                raise ValueError(f"a text is longer than {_PLACE} bytes")
            data, starts = np.frombuffer(raw, np.uint8), ends[:-1] - ends[0]
            sizes = np.diff(ends)
            codes = byte_grams(data)
            # the hash in the high bits, the place in the low ones: the least is the first of the least hashes
            ranked = (codes & ~np.uint64(_PLACE)) | np.arange(len(codes), dtype=np.uint64)
            windows = np.maximum(sizes - width + 1, 0)
            at = ragged(starts, windows)
            doc = np.repeat(np.arange(len(sizes)), windows)
            anchors = (sliding_min(ranked, width - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)[at]
            first, size = runs(at, anchors, doc)
            begin, owner, before = at[first], doc[first], anchors[first] - at[first]
            anchor = codes[anchors[first]]
            del at, doc, anchors, ranked, codes
            digest = _digests(raw, begin, size + width - 1)
            order, edges = _classes([digest[:, 0], digest[:, 1]])
            several = np.diff(np.concatenate((edges, [len(order)]))) > 1
            twice = np.zeros(len(order), bool)
            twice[order] = np.repeat(several, np.diff(np.concatenate((edges, [len(order)]))))
            # rows that repeat id and text have the same marks here
            told = twice & first_of_each(ids, hashes)[owner]
            packed = pack_runs(ids, hashes, owner[told], (begin - starts[owner])[told], size[told], buckets)
            out = [(part, 0, n, *rest) for part, n, *rest in packed]
            send = np.sort(order[edges])
            bucket = (anchor[send] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            send, bucket = send[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            # the tables of all buckets at once, since there are many small ones
            of = owner[send]
            fresh = np.ones(len(send), bool)
            fresh[1:] = of[1:] != of[:-1]
            fresh[cuts] = True
            table = np.empty((len(send), 6), "<i8")
            table[:, 0] = fresh
            table[cuts, 0] = 0
            for i, column in enumerate((begin[send] - starts[of], size[send], before[send], twice[send], (anchor[send] >> np.uint64(32)) & np.uint64(0x7FFFFFFF))):
                table[:, i + 1] = column
            docs = of[fresh]
            first_doc = np.searchsorted(np.flatnonzero(fresh), cuts)
            id_steps = np.diff(ids[docs], prepend=0).astype("<i8")
            id_steps[first_doc] = ids[docs[first_doc]]
            of_docs = hashes[docs].astype("<i8")
            begins, lengths = begin[send].tolist(), (size[send] + width - 1).tolist()
            for a, b, i, j in zip(cuts, [*cuts[1:], len(send)], first_doc, [*first_doc[1:], len(docs)]):
                numbers = numbers_of.compress(planes(id_steps[i:j]) + planes(table[a:b]))
                head = np.array([b - a], "<i8").tobytes() + of_docs[i:j].tobytes()
                text = b"".join([raw[x : x + n] for x, n in zip(begins[a:b], lengths[a:b])])
                out.append((int(bucket[a]), 1, int(j - i), codec.pack(text), head, numbers))
            for a in range(0, len(out), 1000):
                columns = list(zip(*out[a : a + 1000]))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "kind", "n", *COLUMNS])

    return cut


def _bucket(width: int, parts: int, dictionary: bytes = b""):
    def judge(table):
        release()
        codec = Codec(dictionary)
        ids, hashes, tables, texts, docs = [], [], [], [], 0
        open_numbers = zstandard.ZstdDecompressor().decompress
        for n, text, head, rest in zip(*(table[c].to_pylist() for c in ("n", *COLUMNS))):
            numbers = np.frombuffer(head, "<i8")
            packed = np.frombuffer(open_numbers(rest), np.uint8)
            ids.append(np.cumsum(unpacked(packed[: 8 * n], 1)[0]))
            hashes.append(numbers[1:])
            columns = unpacked(packed[8 * n :], 6)
            columns[0] = np.cumsum(columns[0]) + docs
            tables.append(columns)
            texts.append(codec.unpack(text))
            docs += n
        data = b"".join(texts)
        del texts
        ids, hashes, (doc, start, size, before, twice, anchor) = np.concatenate(ids), np.concatenate(hashes), np.concatenate(tables, axis=1)
        length = size + width - 1
        begin = np.cumsum(length) - length
        digest = _digests(data, begin, length)
        order, edges = _classes([digest[:, 0], digest[:, 1], anchor])
        members = np.diff(np.concatenate((edges, [len(order)])))
        many = np.add.reduceat(1 + twice[order], edges) > 1 if len(order) else np.zeros(0, bool)
        whole = np.zeros(len(order), bool)
        whole[order] = np.repeat(many, members)
        lead = order[edges]
        next_too = anchor[lead][1:] == anchor[lead][:-1]
        shared = np.zeros(len(lead), bool)
        shared[:-1] |= next_too
        shared[1:] |= next_too
        shared = np.flatnonzero(shared)
        found_doc, found_start, found_size = [doc[whole]], [start[whole]], [size[whole]]
        if len(shared):
            strings = lead[shared]
            flags = repeated_starts(np.frombuffer(data, np.uint8), begin[strings], length[strings], before[strings], width)
            owner = np.repeat(strings, size[strings])
            place = np.arange(len(flags)) - np.repeat(np.cumsum(size[strings]) - size[strings], size[strings])
            hit = np.flatnonzero(flags & ~whole[owner])
            first, count = runs(place[hit], owner[hit])
            mine = owner[hit[first]]
            found_doc.append(doc[mine])
            found_start.append(start[mine] + place[hit[first]])
            found_size.append(count)
        rows = list(pack_runs(ids, hashes, *(np.concatenate(x) for x in (found_doc, found_start, found_size)), parts))
        columns = list(zip(*rows)) or [(), (), (), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("part", "n", *COLUMNS), columns, kinds)})

    return judge


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Marks (id, hash of the text, starts, sizes): runs of windows of ``width`` bytes that also start elsewhere."""
    if width < 2 * GRAM or width > 254:
        raise ValueError(f"width must lie between {2 * GRAM} and 254")
    total, rows = docs.select(F.sum(F.octet_length(text_col)), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / BUCKET_BYTES))
    dictionary = dictionary_of(docs, rows, id_col, text_col)
    cut = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")
    ).mapInArrow(_cutter(buckets, width, dictionary), _PIECES)
    judge = _bucket(width, buckets, dictionary)

    def marks(key, table):
        if key[1].as_py():
            return judge(table)
        return table.select(["bucket", "n", *COLUMNS]).rename_columns(["part", "n", *COLUMNS])

    # marks made before the shuffle pass through it in groups of their own
    packed = cut.groupBy("bucket", "kind").applyInArrow(marks, "part int, n long, first binary, second binary, third binary")
    return packed.groupBy("part").applyInArrow(merge_runs, RUNS)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """All rows and columns, with ``_kept`` (bytes), ``_bytes``, ``_removed`` and ``_spans`` (removed runs)."""

    def judge(text: bytes, starts, sizes):
        if starts is None:
            return text, len(text), 0, 0
        gone = covered(len(text), starts, sizes, width)
        spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
        return np.frombuffer(text, np.uint8)[~gone].tobytes(), len(text), int(gone.sum()), spans

    marks = repeated_bytes(docs, id_col, text_col, width)
    return with_runs(docs, marks, id_col, text_col, "_kept binary, _bytes long, _removed long, _spans long", judge)
