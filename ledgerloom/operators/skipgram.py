"""Skip-gram with negative sampling whose vectors stay in partitions.

Items are dealt to ``B`` blocks, once as centres and once as contexts. A
stratum pairs every centre block with one context block so that no two tasks
share a block; ``B`` strata meet all pairs of blocks and are an epoch. A task
holds two blocks of vectors and the pairs of its cell, and the blocks are
written after every stratum.

Negatives come from one unigram distribution (counts to the power 0.75): in a
stratum, a centre draws its share of negatives for the context block, by that
block's part of the distribution, whether or not it has pairs there. Over an
epoch that is the distribution over all items. Steps are those of Adagrad with
one rate a vector.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.sequence import with_row_id
from ledgerloom.session import drop_path, materialize, scratch_path

# Items of a block: two blocks of vectors of a task take 50 MB in 64 dimensions.
ITEMS_PER_BLOCK = 100_000
POWER = 0.75
RATE = 0.25
_BATCH = 4096
_STATE = "side int, block int, vectors binary, squares binary"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


class Block:
    """Vectors of the items of one block, and the sums of squares that set their rates."""

    def __init__(self, vectors: np.ndarray, squares: np.ndarray):
        self.vectors, self.squares = vectors, squares

    def move(self, at: np.ndarray, step: np.ndarray) -> None:
        """Add the steps of all rows ``at`` together and go along them."""
        own, place = np.unique(at, return_inverse=True)
        order = np.argsort(place, kind="stable")
        total = np.add.reduceat(step[order], np.searchsorted(place[order], np.arange(len(own))), axis=0)
        self.squares[own] += (total * total).mean(axis=1)
        self.vectors[own] += RATE * total / np.sqrt(self.squares[own] + 1e-8)[:, None]


def train_cell(centres: Block, contexts: Block, pairs: tuple, negatives: np.ndarray, draw_from: np.ndarray, draw) -> None:
    """One pass over the pairs (centre, context, weight) of a cell and the negatives of its centres.

    ``negatives`` is the expected weight of negatives by centre, ``draw_from``
    the distribution over the contexts of the block.
    """
    a, b, w = pairs
    upto, chance = np.cumsum(negatives), np.cumsum(draw_from)
    drawn = 0
    if len(chance) and upto[-1] > 0 and chance[-1] > 0:
        # as many draws as their weight in units of a mean pair, spread over the batches
        unit = w.mean() if len(w) else upto[-1] / max(1, len(upto))
        drawn = max(1, int(round(upto[-1] / unit)))
        unit = upto[-1] / drawn
    batches = max(1, ceil((len(a) + drawn) / _BATCH))
    order = draw.permutation(len(a))
    scale = 1 / max(w.mean() if len(w) else 1.0, 1e-30)
    for i in range(batches):
        own = order[i * len(a) // batches : (i + 1) * len(a) // batches]
        m = (i + 1) * drawn // batches - i * drawn // batches
        left, right = a[own], b[own]
        weight, label = w[own] * scale, np.ones(len(own), np.float32)
        if m:
            left = np.concatenate((left, np.searchsorted(upto, draw.random(m) * upto[-1], side="right").clip(max=len(upto) - 1)))
            right = np.concatenate((right, np.searchsorted(chance, draw.random(m) * chance[-1], side="right").clip(max=len(chance) - 1)))
            weight, label = np.concatenate((weight, np.full(m, unit * scale))), np.concatenate((label, np.zeros(m, np.float32)))
        if not len(left):
            continue
        u, v = centres.vectors[left], contexts.vectors[right]
        pull = ((label - _sigmoid((u * v).sum(axis=1))) * weight).astype(np.float32)[:, None]
        centres.move(left, pull * v)
        contexts.move(right, pull * u)


def _trainer(blocks: int, size: int, epoch: int, stratum: int, passes: int, negatives: int, seed: int):
    def block_of(row, rows: int) -> Block:
        if row["vectors"] is None:
            draw = np.random.default_rng([seed, row["side"], row["block"]])
            vectors = (draw.random((rows, size), np.float32) - 0.5) / size if row["side"] == 0 else np.zeros((rows, size), np.float32)
            return Block(vectors.astype(np.float32), np.zeros(rows, np.float32))
        return Block(np.frombuffer(row["vectors"], np.float32).reshape(-1, size).copy(), np.frombuffer(row["squares"], np.float32).copy())

    def run(table: pa.Table) -> pa.Table:
        # rows: the two blocks, the counts of their items, and the pairs of the cell
        rows = {(r["kind"], r["side"]): r for r in table.filter(pa.compute.less(table["kind"], 2)).to_pylist()}
        cell = [r for r in table.filter(pa.compute.equal(table["kind"], 2)).to_pylist()]
        counts = [np.frombuffer(rows[1, side]["vectors"], np.float64) if (1, side) in rows else np.zeros(0) for side in (0, 1)]
        centres, contexts = (block_of(rows[0, side], len(counts[side])) for side in (0, 1))
        a, b = (np.concatenate([np.frombuffer(r[c], np.int32) for r in cell]) if cell else np.zeros(0, np.int32) for c in ("vectors", "squares"))
        w = np.concatenate([np.frombuffer(r["weights"], np.float64) for r in cell]) if cell else np.zeros(0)
        order = np.lexsort((b, a))
        pairs = a[order], b[order], w[order]
        part = counts[1] ** POWER
        share = part.sum() / rows[1, 1]["total"] if (1, 1) in rows else 0.0
        for turn in range(passes):
            draw = np.random.default_rng([seed, epoch + turn, stratum, rows[0, 0]["block"]])
            train_cell(centres, contexts, pairs, negatives * counts[0] * share, part, draw)
        made = [
            {"side": side, "block": rows[0, side]["block"], "vectors": x.vectors.tobytes(), "squares": x.squares.tobytes()}
            for side, x in enumerate((centres, contexts))
        ]
        return pa.Table.from_pylist(made, pa.schema([("side", pa.int32()), ("block", pa.int32()), ("vectors", pa.binary()), ("squares", pa.binary())]))

    return run


def _packed_counts(table: pa.Table) -> pa.Table:
    order = np.argsort(table["at"].to_numpy())
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int32()),
        "counts": pa.array([table["total"].to_numpy()[order].astype(np.float64).tobytes()], pa.binary()),
    })


def _packed_pairs(batches):
    """Pairs of a batch, one row a cell."""
    for batch in batches:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        a, b = batch.column("a").to_numpy().astype(np.int32), batch.column("b").to_numpy().astype(np.int32)
        n = batch.column("n").to_numpy().astype(np.float64)
        order = np.lexsort((j, i))
        cuts = np.flatnonzero((np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        parts = [p for p in np.split(order, cuts) if len(p)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i[p[0]] for p in parts], pa.int32()), pa.array([j[p[0]] for p in parts], pa.int32()),
                *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (a, b, n)),
            ],
            ["i", "j", "a", "b", "n"],
        )


def fit_skipgram(
    pairs: DataFrame, size: int = 64, epochs: int = 5, negatives: int = 5, seed: int = 1, items_per_block: int = ITEMS_PER_BLOCK
) -> DataFrame:
    """(pid, embedding_vector) from (a, b, n): ``n`` times ``b`` is a context of ``a``.

    ``pairs`` holds both directions. The result does not depend on partitions.
    """
    spark = pairs.sparkSession
    totals = materialize(pairs.groupBy("a").agg(F.sum("n").alias("total")), "totals")
    numbered = with_row_id(totals, ["a"], "no")
    items = totals.count()
    blocks = max(1, ceil(items / items_per_block))
    spot = F.col("no") - 1
    numbered = materialize(numbered.select(
        F.col("a").alias("pid"), "total", F.pmod(spot, F.lit(blocks)).cast("int").alias("block"), F.floor(spot / blocks).cast("int").alias("at")
    ), "items")
    unigram = numbered.agg(F.sum(F.pow(F.col("total").cast("double"), F.lit(POWER)))).first()[0] or 1.0
    left = numbered.select(F.col("pid").alias("a"), F.col("block").alias("i"), F.col("at").alias("ai"))
    right = numbered.select(F.col("pid").alias("b"), F.col("block").alias("j"), F.col("at").alias("bj"))
    cells = pairs.join(left, "a").join(right, "b").select("i", "j", F.col("ai").alias("a"), F.col("bj").alias("b"), "n")
    cells = materialize(cells.mapInArrow(_packed_pairs, "i int, j int, a binary, b binary, n binary"), "cells")
    counts = materialize(numbered.groupBy("block").applyInArrow(_packed_counts, "block int, counts binary"), "counts")
    none = F.lit(None).cast("binary")
    state = counts.select("block", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), none.alias("vectors"), none.alias("squares"))
    state = state.select("side", "block", "vectors", "squares")
    old = None
    no, nothing = F.lit(None).cast("double"), none.alias("weights")
    # one block needs no strata, so its task goes through all epochs
    rounds = [(0, 0, epochs)] if blocks == 1 else [(e, s, 1) for e in range(epochs) for s in range(blocks)]
    for epoch, stratum, passes in rounds:
        # the centre block ``task`` meets the context block ``task + stratum``
        task = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - stratum, F.lit(blocks))).alias("task")
        both = counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "block", "counts")
        rows = state.select(task, F.lit(0).alias("kind"), "side", "block", "vectors", "squares", nothing, no.alias("total"))
        rows = rows.union(both.select(
            task, F.lit(1).alias("kind"), "side", "block", "counts", none.alias("squares"), nothing, F.lit(float(unigram)).alias("total")
        ))
        rows = rows.union(
            cells.where(F.col("j") == F.pmod(F.col("i") + stratum, F.lit(blocks)))
            .select(F.col("i").alias("task"), F.lit(2).alias("kind"), F.lit(0).alias("side"), "i", "a", "b", "n", no.alias("total"))
        )
        path = scratch_path(spark, "skipgram")
        trained = rows.repartition(blocks, "task").groupBy("task").applyInArrow(
            _trainer(blocks, size, epoch, stratum, passes, negatives, seed), _STATE
        )
        trained.write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if old:
            drop_path(spark, old)
        old = path

    def unpacked(batches):
        for batch in batches:
            for block, vectors in zip(batch.column("block").to_pylist(), batch.column("vectors").to_pylist()):
                rows = np.frombuffer(vectors, np.float32).reshape(-1, size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), block, np.int32)), pa.array(np.arange(len(rows), dtype=np.int32)), lists],
                    ["block", "at", "embedding_vector"],
                )

    vectors = state.where("side = 0").mapInArrow(unpacked, "block int, at int, embedding_vector array<float>")
    done = materialize(numbered.join(vectors, ["block", "at"]).select("pid", "embedding_vector"), "vectors")
    if old:
        drop_path(spark, old)
    return done
