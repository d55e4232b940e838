"""Boosted regression trees from histograms of binned rows.

Features are binned once, by quantiles, to at most ``BINS`` values of a byte.
Rows of equal bytes are one group with their number and the sum of their labels;
squared error needs no more, since a tree cannot tell them apart. A level of a
tree takes one aggregate: number and residual of every (node, feature, bin).

Few groups, by count, are trained by one task. Many are packed into blocks and stay
where they are: a job a level adds up the histograms of the tasks, and the predictions
so far are written into the table every ``REWRITE`` trees.

The fitted model is a pipeline stage that is saved with its pipeline. It scores
Arrow batches of the feature columns, a tree at a time for all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ledgerloom.session import drop_path, materialize, scratch_path

BINS = 32
# Groups that one task trains on: some 30 bytes each and a few arrays.
SMALL_GROUPS = 400_000
REWRITE = 4
# Groups of a packed row, and packed rows that a task works on at a time.
BLOCK, BLOCKS = 4096, 64


@dataclass
class Tree:
    """A full tree by levels: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``.

    A node without a split sends all rows left (feature 0, bin 255).
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def nodes(self, codes: np.ndarray, level: int) -> np.ndarray:
        """The node of a level that each row comes to."""
        node = np.zeros(len(codes), np.int64)
        flat, row = codes.reshape(-1), np.arange(len(codes)) * codes.shape[1]
        for _ in range(level):
            node = 2 * node + 1 + (flat[row + self.feature[node]] > self.bin[node])
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        depth = (len(self.value) + 1).bit_length() - 2
        return self.value[self.nodes(codes, depth)]


def empty_tree(depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.zeros(size, np.int64), np.full(size, 255), np.zeros(size))


class Bundles:
    """Codes of several features of few bins as one number, so that one count serves them all."""

    def __init__(self, codes: np.ndarray, sizes: list[int]):
        self.features = len(sizes)
        self.parts: list[tuple[np.ndarray, list[int], list[int]]] = []
        todo = sorted(range(len(sizes)), key=sizes.__getitem__)
        while todo:
            own = [todo.pop(0)]
            shape = [sizes[own[0]]]
            while todo and np.prod(shape) * sizes[todo[0]] <= 4 * BINS:
                own.append(todo.pop(0))
                shape.append(sizes[own[-1]])
            joint = np.zeros(len(codes), np.int64)
            for f, size in zip(own, shape):
                joint = joint * size + codes[:, f]
            self.parts.append((joint, own, shape))


def histograms(bundles: Bundles, n: np.ndarray, residual: np.ndarray, place: np.ndarray, nodes: int) -> np.ndarray:
    """Number and residual by (node, feature, bin); ``place`` is a node of the level."""
    out = np.zeros((2, nodes, bundles.features, BINS))
    for joint, own, shape in bundles.parts:
        size = int(np.prod(shape))
        cell = place * size + joint
        for what, weights in enumerate((n, residual)):
            found = np.bincount(cell, weights, nodes * size).reshape(nodes, *shape)
            for i, f in enumerate(own):
                others = tuple(1 + j for j in range(len(own)) if j != i)
                out[what, :, f, : shape[i]] = found.sum(axis=others)
    return out


def grow_level(tree: Tree, level: int, found: np.ndarray, gains: np.ndarray) -> None:
    """Splits of greatest gain of the nodes of a level, and the values of their children."""
    first = 2**level - 1
    if level == 0:
        n, total = found[0, 0, 0].sum(), found[1, 0, 0].sum()
        tree.value[0] = total / n if n else 0.0
    for i in range(2**level):
        node = first + i
        tree.value[2 * node + 1 : 2 * node + 3] = tree.value[node]
        n, total = found[0, i, 0].sum(), found[1, i, 0].sum()
        if n == 0:
            continue
        left_n, left = found[0, i].cumsum(1)[:, :-1], found[1, i].cumsum(1)[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n
        gain = np.where((left_n > 0) & (left_n < n), gain, -np.inf)
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] > 1e-12 * max(1.0, total**2 / n):
            tree.feature[node], tree.bin[node] = f, b
            tree.value[2 * node + 1], tree.value[2 * node + 2] = left[f, b] / left_n[f, b], (total - left[f, b]) / (n - left_n[f, b])
            gains[f] += gain[f, b]


def boost(columns: int, rounds: int, depth: int, step: float, find) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and their gains; ``find(trees, tree, level)`` gives the histograms of a level."""
    trees: list[Tree] = []
    gains = []
    for turn in range(rounds):
        tree, gain = empty_tree(depth), np.zeros(columns)
        for level in range(depth):
            grow_level(tree, level, find(trees, tree, level), gain)
            if not (tree.bin[2**level - 1 : 2 ** (level + 1) - 1] < 255).any():
                for node in range(2 ** (level + 1) - 1, len(tree.value) // 2):
                    tree.value[2 * node + 1 : 2 * node + 3] = tree.value[node]
                break
        if turn:
            tree.value = tree.value * step
        trees.append(tree)
        gains.append(gain)
    return trees, gains


def _rows(batches, columns: int):
    """Codes, numbers, label sums and predictions of all batches of a task."""
    parts = [(b.column("codes").to_pylist(), *(b.column(c).to_numpy() for c in ("n", "s", "p"))) for b in batches if len(b)]
    if not parts:
        return np.zeros((0, columns), np.uint8), np.zeros(0), np.zeros(0), np.zeros(0)
    codes = np.concatenate([np.frombuffer(b"".join(p[0]), np.uint8).reshape(-1, columns) for p in parts])
    return codes, *(np.concatenate([p[i] for p in parts]).astype(np.float64) for i in (1, 2, 3))


def _train_here(sizes: list[int], rounds: int, depth: int, step: float):
    """All rounds over the groups of one task."""
    columns = len(sizes)

    def run(batches):
        codes, n, s, p = _rows(batches, columns)
        bundles, done = Bundles(codes, sizes), [0]

        def find(trees, tree, level):
            for t in trees[done[0] :]:
                p[:] += t.predict(codes)
            done[0] = len(trees)
            return histograms(bundles, n, s - n * p, tree.nodes(codes, level) - (2**level - 1), 2**level)

        trees, gains = boost(columns, rounds, depth, step, find)
        yield pa.RecordBatch.from_pydict({
            "turn": pa.array(range(len(trees)), pa.int32()), "feature": pa.array([t.feature.tolist() for t in trees], pa.list_(pa.int64())),
            "bin": pa.array([t.bin.tolist() for t in trees], pa.list_(pa.int64())),
            "value": pa.array([t.value.tolist() for t in trees], pa.list_(pa.float64())),
            "gain": pa.array([g.tolist() for g in gains], pa.list_(pa.float64())),
        })

    return run


_TREES = "turn int, feature array<bigint>, bin array<bigint>, value array<double>, gain array<double>"


_BLOCKS = "codes binary, n binary, s binary, p binary"


def _packed(columns: int):
    """Groups as rows of ``BLOCK``, made where they are read, so that a pass over them is one over few rows."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(_rows([batch], columns))
            size += len(held[-1][0])
            if size >= BLOCK:
                yield from _blocks(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield from _blocks(*(np.concatenate(x) for x in zip(*held)))

    return run


def _blocks(*arrays: np.ndarray):
    cut = range(0, len(arrays[0]), BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array([a[at : at + BLOCK].tobytes() for at in cut], pa.binary()) for a in arrays], ["codes", "n", "s", "p"])


def _unpacked(batches, columns: int):
    """The same four arrays as ``_rows``, of some packed rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), BLOCKS):
            codes, *numbers = (b"".join(c.to_pylist()) for c in batch.slice(at, BLOCKS).columns)
            n, s, p = (np.frombuffer(x, np.float64) for x in numbers)
            yield np.frombuffer(codes, np.uint8).reshape(-1, columns), n, s, p.copy()


def _boost_in_jobs(groups: DataFrame, sizes: list[int], rounds: int, depth: int, step: float) -> tuple[list[Tree], list[np.ndarray]]:
    """As ``_train_here``, by one aggregate a level; what reaches the driver is (node, feature, bin) sums."""
    spark, columns = groups.sparkSession, len(sizes)
    held: dict = {"table": None, "path": None, "from": 0}

    def write(df: DataFrame, trees: int) -> None:
        path = scratch_path(spark, "boosted")
        df.write.parquet(path)
        if held["path"]:
            drop_path(spark, held["path"])
        held.update({"table": spark.read.schema(_BLOCKS).parquet(path), "path": path, "from": trees})

    def predicted(trees):
        def run(batches):
            for codes, n, s, p in _unpacked(batches, columns):
                for t in trees:
                    p += t.predict(codes)
                yield from _blocks(codes, n, s, p)

        return run

    def find(trees, tree, level):
        if len(trees) - held["from"] >= REWRITE:
            write(held["table"].mapInArrow(predicted(trees[held["from"] :]), _BLOCKS), len(trees))
        since = trees[held["from"] :]

        def part(batches):
            out = np.zeros((2, 2**level, columns, BINS))
            for codes, n, s, p in _unpacked(batches, columns):
                for t in since:
                    p += t.predict(codes)
                out += histograms(Bundles(codes, sizes), n, s - n * p, tree.nodes(codes, level) - (2**level - 1), 2**level)
            cell = np.flatnonzero(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(out[0].reshape(-1)[cell]), pa.array(out[1].reshape(-1)[cell])], ["cell", "n", "r"]
            )

        sums = held["table"].mapInArrow(part, "cell bigint, n double, r double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
        found = np.zeros((2, 2**level * columns * BINS))
        for row in sums.collect():
            found[:, row.cell] = row.n, row.r
        return found.reshape(2, 2**level, columns, BINS)

    write(groups.select("codes", "n", "s", "p").mapInArrow(_packed(columns), _BLOCKS), 0)
    made = boost(columns, rounds, depth, step, find)
    drop_path(spark, held["path"])
    return made


@dataclass
class Boosted:
    trees: list[Tree]
    edges: list[np.ndarray]
    importances: list[float]

    def to_json(self) -> str:
        trees = [[x.tolist() for x in (t.feature, t.bin, t.value)] for t in self.trees]
        return json.dumps({"trees": trees, "edges": [e.tolist() for e in self.edges], "importances": self.importances})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        kept = json.loads(text)
        return cls([Tree(*map(np.array, t)) for t in kept["trees"]], [np.array(e) for e in kept["edges"]], kept["importances"])

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x) for e, x in zip(self.edges, columns)], axis=1).astype(np.uint8)
        out = np.zeros(len(codes))
        for tree in self.trees:
            out += tree.predict(codes)
        return out


class BoostedTrees(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction of boosted trees over feature columns (doubles without nulls)."""

    model = Param(Params._dummy(), "model", "trees, bin edges and importances as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="prediction", model=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None}, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.model)
        held: list[Boosted] = []

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            if not held:
                held.append(Boosted.from_json(text))
            for columns in batches:
                yield pd.Series(held[0].predict([c.to_numpy() for c in columns]))

        return dataset.withColumn(self.getOutputCol(), predict(*self.getInputCols()))


def quantile_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper edges of all bins but the last, for every column."""
    found = rows.approxQuantile(columns, [(i + 1) / bins for i in range(bins)], 0.002)
    return [np.unique(e)[:-1] for e in found]


def fit_boosted(
    rows: DataFrame, columns: list[str], label: str = "label", rounds: int = 100, depth: int = 3, step: float = 0.1,
    small_groups: int = SMALL_GROUPS,
) -> Boosted:
    """Least-squares boosting; columns and label are doubles without nulls.

    The first tree is added in full, later ones times ``step``.
    """
    edges = quantile_edges(rows, columns)

    def coded(batches):
        for batch in batches:
            codes = np.stack([np.searchsorted(e, batch.column(i).to_numpy()) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(len(edges))], ["codes", "y"])

    binned = rows.select(*columns, F.col(label).alias("y")).mapInArrow(coded, "codes binary, y double")
    groups = binned.groupBy("codes").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.lit(0.0).alias("p"))
    groups = materialize(groups, "groups")
    sizes = [len(e) + 1 for e in edges]
    if groups.count() <= small_groups:
        found = groups.coalesce(1).mapInArrow(_train_here(sizes, rounds, depth, step), _TREES).orderBy("turn").collect()
        trees = [Tree(*(np.array(r[c]) for c in ("feature", "bin", "value"))) for r in found]
        gains = [np.array(r.gain) for r in found]
    else:
        trees, gains = _boost_in_jobs(groups, sizes, rounds, depth, step)
    shares = [g / g.sum() for g in gains if g.sum() > 0]
    total = np.sum(shares, axis=0) if shares else np.ones(len(columns))
    return Boosted(trees, edges, (total / total.sum()).tolist())
