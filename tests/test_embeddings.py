"""Embeddings put products of one community together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import embeddings as E
from ledgerloom.operators.skipgram import Block, fit_skipgram, train_cell
from ledgerloom.operators.walks import random_walks


@pytest.fixture(scope="module")
def walks(spark):
    """Two groups of ten products, each all connected, joined by one edge."""
    edges = [(g + a, g + b, 5) for g in (0, 100) for a in range(10) for b in range(a)] + [(100, 9, 1)]
    graph = spark.createDataFrame(edges, "pid_1 bigint, pid_2 bigint, occurrence_ct bigint")
    return random_walks(graph, num_walks=6, length=20).cache()


@pytest.mark.parametrize("method", ["skipgram", "factors"])
def test_nearest_product_is_of_the_same_group(walks, method):
    vectors = E.embed_walks(walks, size=8, window=4, method=method)
    assert vectors.count() == 20
    similar = E.similar_items(vectors, k=1).collect()
    assert sum((r.pid >= 100) == (r.similar >= 100) for r in similar) >= 18


def test_strata_train_all_pairs_of_blocks(spark, walks):
    pairs = E.cooccurrences(walks, 4)
    vectors = fit_skipgram(pairs, size=8, epochs=3, items_per_block=7)
    assert vectors.count() == 20
    similar = E.similar_items(vectors, k=1).collect()
    assert sum((r.pid >= 100) == (r.similar >= 100) for r in similar) >= 18
    again = {r.pid: r.embedding_vector for r in fit_skipgram(pairs.repartition(3), size=8, epochs=3, items_per_block=7).collect()}
    assert all(np.allclose(again[r.pid], r.embedding_vector, atol=1e-4) for r in vectors.collect())


def test_a_cell_pulls_pairs_together_and_negatives_apart():
    draw = np.random.default_rng(1)
    centres = Block((draw.random((4, 6), np.float32) - 0.5), np.zeros(4, np.float32))
    contexts = Block((draw.random((4, 6), np.float32) - 0.5), np.zeros(4, np.float32))
    pairs = np.array([0, 1], np.int32), np.array([0, 1], np.int32), np.array([5.0, 5.0])
    for _ in range(60):
        train_cell(centres, contexts, pairs, np.array([5.0, 5.0, 0.0, 0.0]), np.array([0.0, 0.0, 1.0, 1.0]), draw)
    score = centres.vectors @ contexts.vectors.T
    assert min(score[0, 0], score[1, 1]) > 1 and score[:2, 2:].max() < -1


def test_cooccurrences_within_the_window(spark):
    one = spark.createDataFrame([(1, 1, [1, 2, 3, 1])], "start bigint, walk_no int, path array<bigint>")
    got = {(r.a, r.b): r.n for r in E.cooccurrences(one, 2).collect()}
    path, want = [1, 2, 3, 1], {}
    for i, a in enumerate(path):
        for j, b in enumerate(path):
            if 0 < abs(i - j) <= 2:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_projection_equals_principal_axes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "pid bigint, embedding_vector array<double>")
    got = np.array([[r.x0, r.x1] for r in E.project_embeddings(df, 2).orderBy("pid").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(unit.T))
    want = unit @ axes[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def test_unknown_id_gives_no_row(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "pid bigint, embedding_vector array<double>")
    ids = spark.range(5, 6)
    assert E.similar_items(df, ids).count() == 0
