"""Words, chunks and hashes of Arrow text columns, shared by the operators of this package.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Everything here
works on one bounded chunk of rows at a time, inside a Spark task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give freed memory back, since a Python worker lives on between the tasks of an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches so that ``column`` holds about ``limit`` bytes; a longer row comes alone."""
    release()
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max(limit - size, 1), side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    del held
    release()


@dataclass
class Words:
    """``ids`` index ``vocabulary``; document ``i`` owns ``counts[i]`` consecutive ids."""

    ids: np.ndarray
    vocabulary: pa.Array
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)[:-1])).astype(np.int64) if len(self.counts) else self.counts

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words of every text, exactly encoded by a dictionary; null is a text without words.

    ``lower`` maps A-Z only.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int32),
        coded.dictionary,
        np.bincount(owner, minlength=len(sizes)).astype(np.int64),
    )


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings of any Arrow type, the same in every task."""
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    if pa.types.is_large_binary(strings.type):
        strings = strings.view(pa.large_string())
    return pd.util.hash_array(np.asarray(strings.to_numpy(zero_copy_only=False), object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive 64-bit values, at the place of the first; shorter by ``width - 1``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = values[:n].copy()
        for j in range(1, width):
            out *= _ODD
            out += values[j : j + n]
    return mix(out)


def whole(counts: np.ndarray, width: int) -> np.ndarray:
    """Which of the ``sum(counts) - width + 1`` places start a window that stays in its document."""
    n = int(counts.sum()) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return np.arange(n) + width <= ends


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        step = width - have
        out = np.minimum(out[: len(out) - step], out[step:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all ``i``, one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def runs(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut ascending ``places`` where they are not consecutive or a value of ``same`` changes.

    Returns the index of the first place of every run, and the run lengths.
    """
    if len(places) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(places) != 1
    for values in same:
        cut |= values[1:] != values[:-1]
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    return first, np.diff(np.concatenate((first, [len(places)])))
