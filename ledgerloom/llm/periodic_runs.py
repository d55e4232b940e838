"""Maximal periodic runs of words: a suffix automaton with link-cut access.

1. The words of a chunk of texts are numbered. A run of at least twelve words is
   covered by six-word windows that occur twice in its text, and so is no word
   that would extend it; a text is therefore cut into the stretches that such
   windows cover, and words outside them are in no run.
2. The suffix automaton of a stretch has a tree of suffix links. Words are
   appended one by one: access to the state of the new prefix recolours the path
   from the root with the new end. The path falls into segments by the colour
   they had, which is the last place where their strings ended. A segment of
   depth ``L`` whose strings ended ``p <= L`` places before closes a square of
   primitive period ``p`` that begins ``p + L - 1`` places back. Splay trees hold
   the segments, so appending a word takes logarithmic time on average.
3. Squares of one begin and period are one run; its end is the last of them.

A run is a maximal stretch with smallest period ``p`` of at least two periods
and ``LEAST`` words. Texts are independent rows: nothing is shuffled.

Cases: a null text is a text without words and has no runs; ids may be null or
repeat, and repeated rows are judged alike; other columns are kept, whatever
their names; an empty table gives no rows. A stretch takes about a kilobyte of
memory a word; a text longer than a chunk is handled alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.llm.words import chunks, hash_strings, grams, split_words, whole

LEAST = 12
#: Half of the least run: either half of a run that short occurs twice.
WINDOW = LEAST // 2
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_CHUNK = 4 << 20


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and length of every state, and the state of every prefix. State 0 is the root, its link -1."""
    link, size, step, ends = [-1], [0], [{}], []
    last = 0
    for n, w in enumerate(word, 1):
        state = len(link)
        link.append(0)
        size.append(n)
        step.append({})
        at = last
        while at >= 0 and w not in step[at]:
            step[at][w] = state
            at = link[at]
        if at >= 0:
            to = step[at][w]
            if size[to] != size[at] + 1:
                copy = len(link)
                link.append(link[to])
                size.append(size[at] + 1)
                step.append(step[to].copy())
                link[to] = copy
                while at >= 0 and step[at].get(w) == to:
                    step[at][w] = copy
                    at = link[at]
                to = copy
            link[state] = to
        last = state
        ends.append(state)
    return link, size, ends


class RootPaths:
    """A forest of splay trees, one for each coloured path of a fixed tree, ordered by depth.

    A node without a splay parent is the top of its splay tree; there ``above``
    is the tree node over the path and ``colour`` the path's colour (-1: none).
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.low, self.high = [-1] * n, [-1] * n, [-1] * n  # splay parent, shallower child, deeper child
        self.above, self.colour = list(parent), [-1] * n

    def _lift(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        p = up[x]
        g = up[p]
        if low[p] == x:
            c = high[x]
            low[p] = c
            high[x] = p
        else:
            c = low[x]
            high[p] = c
            low[x] = p
        if c >= 0:
            up[c] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if low[g] == p:
                low[g] = x
            else:
                high[g] = x
        else:
            self.above[x], self.colour[x] = self.above[p], self.colour[p]

    def splay(self, x: int) -> None:
        up, low = self.up, self.low
        while (p := up[x]) >= 0:
            g = up[p]
            if g >= 0:
                self._lift(p if (low[g] == p) == (low[p] == x) else x)
            self._lift(x)

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``x``; the segments it had: deepest node and colour, deepest first."""
        high, up = self.high, self.up
        found = []
        deeper = -1
        while x >= 0:
            if up[x] >= 0:
                self.splay(x)
            old = self.colour[x]
            if old >= 0:
                found.append((x, old))
            cut = high[x]
            if cut >= 0:  # what lies deeper keeps its colour as a path of its own
                up[cut], self.above[cut], self.colour[cut] = -1, x, old
            high[x] = deeper
            if deeper >= 0:
                up[deeper] = x
            deeper, x = x, self.above[x]
        self.colour[deeper] = colour
        return found


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    link, size, ends = suffix_automaton(word)
    paths = RootPaths(link)
    last: dict[tuple[int, int], int] = {}
    for n, state in enumerate(ends):
        for deepest, before in paths.access(state, n):
            period, depth = n - before, size[deepest]
            if period <= depth:
                last[(n - period - depth + 1, period)] = n
    return sorted((s, e - s + 1, p) for (s, p), e in last.items() if e - s + 1 >= least)


def covered_stretches(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of words in windows that occur twice in their document: begins and ends."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = whole(counts, window)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    key = grams(codes, window)[at]
    order = np.lexsort((key, owner[at]))
    same = (np.diff(owner[at][order]) == 0) & (np.diff(key[order]) == 0)
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(owner) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    cover = np.cumsum(edge[:-1]) > 0
    # a stretch ends with its document
    first = cover & ~np.concatenate(([False], cover[:-1] & (owner[1:] == owner[:-1])))
    last = cover & ~np.concatenate((cover[1:] & (owner[1:] == owner[:-1]), [False]))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _judge(texts) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[str]]:
    """Number of words, runs and collapsed text of every text."""
    words = split_words(texts)
    counts, starts = words.counts, words.starts
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    drop = np.zeros(len(words.ids), bool)
    begins, ends = covered_stretches(hash_strings(words.vocabulary)[words.ids], counts)
    docs = np.searchsorted(np.cumsum(counts), begins, side="right")
    for doc, a, b in zip(docs.tolist(), begins.tolist(), ends.tolist()):
        for start, length, period in runs_of(words.ids[a:b].tolist()):
            found[doc].append((a - int(starts[doc]) + start, length, period))
            drop[a + start + period : a + start + length] = True
    owner = np.repeat(np.arange(len(counts)), counts)[~drop]
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(counts)))))
    kept = words.vocabulary.cast(pa.string()).take(pa.array(words.ids[~drop]))
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), kept)
    return counts, found, pc.binary_join(lists, " ").to_pylist()


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _report(batches):
    for chunk in chunks(batches, "text", _CHUNK):
        counts, found, collapsed = _judge(chunk.column("text"))
        flat = [r for runs in found for r in runs]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
        columns = list(zip(*flat)) if flat else [[], [], []]
        fields = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
        listed = ["".join(f"{s},{n},{p}\n" for s, n, p in runs) for runs in found]
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("row").combine_chunks(), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), fields),
                pa.array([_digest(x) for x in listed]), pa.array(collapsed, pa.string()),
            ],
            ["row", "n_words", "runs", "runs_sha256", "collapsed"],
        )


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, then n_words, runs, runs_sha256 and collapsed.

    ``runs`` holds start, length and period in words; ``runs_sha256`` hashes a
    line ``start,length,period`` for each; ``collapsed`` keeps, of every run,
    its first period, words joined by one space. A column of ``docs`` that has
    the name of a new one is left out.
    """
    new = ["n_words", "runs", "runs_sha256", "collapsed"]
    others = [f.name for f in docs.schema if f.name != text_col and f.name.lower() not in new]
    quoted = ["`" + n.replace("`", "``") + "`" for n in others]
    row = F.struct(*(F.col(q).alias(f"c{i}") for i, q in enumerate(quoted))) if others else F.struct(F.lit(0).alias("none"))
    text = F.col("`" + text_col.replace("`", "``") + "`")
    packed = docs.select(row.alias("row"), text.alias("text"))
    kinds = [packed.schema["row"].dataType, T.LongType(), RUNS, T.StringType(), T.StringType()]
    judged = packed.mapInArrow(_report, T.StructType([T.StructField(n, k) for n, k in zip(["row", *new], kinds)]))
    return judged.select(*(F.col(f"row.c{i}").alias(n) for i, n in enumerate(others)), *new)
