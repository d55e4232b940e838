"""Packing by power-of-two decomposition.

A document of T tokens is cut into ``T // 2048`` pieces of 2048 tokens and one
piece for every set bit of the rest, longest first. A piece is a sequence of
its own, so no sequence crosses documents and none needs padding; sequences of
equal length form a bucket that is trained on together. Nothing is shuffled:
every task cuts its own documents.

Cases: a null or empty text is the end token alone; a null id stays null;
repeated rows are cut like any others, each piece with its own sequence id;
columns other than id and text are not read; an empty table gives no rows.
A text of any length is cut within the memory of its own ids; else a task holds
what ``CHUNK`` bytes of text take, and the ids of the words it has met.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.words import chunks, ragged, split_words

MAX_LENGTH = 2048
END = 1
#: Bytes of text that are cut at once: words, ids and pieces take many times as much.
CHUNK = 3 << 20
#: Bytes of distinct words whose ids a task keeps from one chunk to the next.
KNOWN = 8 << 20
#: Bytes and strings that go to the tokenizer at once: its encodings are many times as large as their ids.
CALL, CALL_STRINGS = 64 << 10, 2048
#: Pieces that are digested at once.
DIGESTED = 1000

# The steps of a tokenizer that reads words.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}

_loaded: dict = {}  # tokenizers, their word ends and whether they read words, by path


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def binary_pieces(tokens: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document, longest first; each is a power of two."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _encode(strings: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all strings, one after another, and how many each has."""
    tokenizer = _tokenizer(path)
    ends = np.cumsum(pc.binary_length(strings).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, sizes, at = [np.zeros(0, np.uint32)], [], 0
    while at < len(strings):
        before = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + CALL, side="right"))), at + CALL_STRINGS)
        ids = [e.ids for e in tokenizer.encode_batch_fast(strings.slice(at, stop - at).to_pylist(), add_special_tokens=False)]
        parts.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
        sizes.extend(map(len, ids))
        at = stop
    return np.concatenate(parts), np.array(sizes, np.int64)


def _encode_letters(strings: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings of letters only, many to a call: the last id of each is one that ends a word."""
    words = strings.to_pylist()
    lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
    ids, _ = _encode(pa.array(lines, pa.string()), path)
    ends = np.flatnonzero(_ends_word(path)[ids])
    if len(ends) != len(words):
        return _encode(strings, path)
    return ids, np.diff(ends, prepend=-1)


def _ends_word(path: str) -> np.ndarray:
    key = (path, "ends")
    if key not in _loaded:
        vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
        _loaded[key] = np.zeros(max(vocabulary.values()) + 1, bool)
        _loaded[key][[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return _loaded[key]


def reads_words(path: str) -> bool:
    """Whether the ids of a text are those of its words: the tokenizer lower-cases and drops white space before it merges."""
    key = (path, "words")
    if key not in _loaded:
        made = json.loads(_tokenizer(path).to_str())
        known = all(token["content"].startswith("<|") for token in made["added_tokens"])
        _loaded[key] = known and made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
    return _loaded[key]


def word_ids(vocabulary: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after another, and how many each has.

    Words that differ only in A-Z or in one full stop or comma at the end share
    the encoding of their stem: the tokenizer lower-cases, and it cuts between
    a letter or digit and such a mark. Words that may hold a special token, or the one
    capital whose lower case ends in a mark, stay as they are.
    """
    plain = pc.invert(pc.match_substring_regex(vocabulary, "<[|]|\u0130"))
    lower = pc.if_else(plain, pc.ascii_lower(vocabulary), vocabulary)
    marked = pc.and_(plain, pc.match_substring_regex(lower, r"[\pL\pN][.,]$"))
    stem = pc.if_else(marked, pc.utf8_slice_codeunits(lower, 0, -1), lower)
    coded = pa.concat_arrays([stem, pa.array([".", ","], stem.type)]).dictionary_encode()
    strings, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    simple = pc.match_substring_regex(strings, r"^\pL+$")
    simple = pc.and_(simple, pc.invert(pc.match_substring(strings, "\u0130"))).to_numpy(zero_copy_only=False)
    flat, sizes, begin, base = [], np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), 0
    for chosen, encode in ((simple, _encode_letters), (~simple, _encode)):
        ids, n = encode(strings.filter(pa.array(chosen)), path)
        sizes[chosen], begin[chosen] = n, base + np.cumsum(n) - n
        flat.append(ids)
        base += len(ids)
    flat = np.concatenate(flat)
    stop, comma = (flat[begin[i] : begin[i] + sizes[i]] for i in index[-2:])
    if len(stop) != 1 or len(comma) != 1:
        return _encode(vocabulary, path)
    index, has = index[:-2], marked.to_numpy(zero_copy_only=False)
    own = sizes[index]
    out = np.zeros(int(own.sum() + has.sum()), np.uint32)
    ends = np.cumsum(own + has)
    out[ragged(ends - own - has, own)] = flat[ragged(begin[index], own)]
    last = pc.ends_with(vocabulary, ".").to_numpy(zero_copy_only=False)[has]
    out[ends[has] - 1] = np.where(last, stop[0], comma[0])
    return out, own + has


class KnownWords:
    """Ids of the words of one chunk after another; a word is encoded once until ``KNOWN`` bytes are held."""

    def __init__(self, path: str):
        self.path, self.words = path, pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def find(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, and where in them those of each distinct word begin and how many they are."""
        if self.words.nbytes + vocabulary.nbytes > KNOWN:  # only these words from now on
            self.__init__(self.path)
        at = pc.index_in(vocabulary, value_set=self.words)
        new = at.is_null()
        words = vocabulary.filter(new)
        at, new = at.fill_null(0).to_numpy().copy(), new.to_numpy(zero_copy_only=False)
        at[new] = len(self.words) + np.arange(len(words))
        if len(words):
            flat, sizes = word_ids(words, self.path)
            self.words = pa.concat_arrays([self.words, words])
            self.flat, self.sizes = np.concatenate((self.flat, flat)), np.concatenate((self.sizes, sizes))
        return self.flat, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]


def document_ids(texts, path: str, known: KnownWords | None = None) -> list[np.ndarray]:
    """Token ids of every text, without the end token.

    Where the tokenizer drops white space before it merges, the ids of a text are
    those of its words in order and every distinct word is encoded once, in all
    calls with the same ``known``; another tokenizer reads whole texts.
    """
    if not reads_words(path):
        flat, sizes = _encode(pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, ""), path)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
    words = split_words(texts)
    if not len(words.ids):
        return [np.zeros(0, np.uint32) for _ in words.counts]
    flat, begin, sizes = (known or KnownWords(path)).find(words.vocabulary)
    lengths = sizes[words.ids]
    ids = flat[ragged(begin[words.ids], lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(words.counts)]
    return np.split(ids, ends[:-1])


def _cutter(tokenizer: str, longest: int, end: int):
    def laid_out(chunk: pa.Table, known: KnownWords) -> pa.RecordBatch:
        ids = document_ids(chunk["_text"], tokenizer, known)
        mark = np.array([end], np.uint32)
        # pieces follow one another as the documents do
        values = np.concatenate([part for own in ids for part in (own, mark)]).view(np.int32)
        total = np.array([len(own) + 1 for own in ids], np.int64)
        lengths = [binary_pieces(n, longest) for n in total.tolist()]
        row = np.repeat(np.arange(len(total)), [len(x) for x in lengths])
        length = np.array([n for x in lengths for n in x], np.int64)
        ends = np.cumsum(length)
        return pa.RecordBatch.from_arrays(
            [
                chunk["_id"].combine_chunks().take(pa.array(row)),
                pa.array(ends - length - (np.cumsum(total) - total)[row]),
                pa.array(length),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values)),
                pa.array(total[row]),
            ],
            ["_id", "start", "length", "tokens", "doc_tokens"],
        )

    def cut(batches):
        known = KnownWords(tokenizer)
        # no chunk is held while the next is read
        yield from map(lambda chunk: laid_out(chunk, known), chunks(batches, "_text", CHUNK))

    return cut


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    longest: int = MAX_LENGTH, end: int = END,
) -> DataFrame:
    """One row per piece: id, start, tokens, length, doc_tokens, bucket, sequence_id, offset.

    ``bucket`` is the binary logarithm of the length: write the result
    partitioned by it to get the files of one sequence length together.
    """
    kind = docs.schema[id_col].dataType
    pieces = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _cutter(tokenizer, longest, end), f"_id {kind.simpleString()}, start long, length long, tokens array<int>, doc_tokens long"
    )
    return pieces.select(
        F.col("_id").alias(id_col), "start", "length", "tokens", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def ids_crc32(tokens) -> "pa.Array":
    """CRC-32 of little-endian unsigned 32-bit ids, of every list of a column."""
    flat = pc.list_flatten(tokens).to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends)], pa.int64())


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ``ids_crc32`` in the place of their tokens."""
    keep = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset"]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def digest(batches):
        for batch in batches:
            for at in range(0, len(batch), DIGESTED):
                part = batch.slice(at, DIGESTED)
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, ids_crc32(part.column("tokens"))], [*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids_crc32 long"
    return pieces.select(*keep, "tokens").mapInArrow(digest, schema)
