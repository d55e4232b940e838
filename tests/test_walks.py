"""Random walks: steps follow edges, and the draws have the right chances."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.communities import place_nodes
from ledgerloom.operators.walks import random_walks


def graph(spark, edges):
    return spark.createDataFrame(edges, "pid_1 bigint, pid_2 bigint, occurrence_ct bigint")


STAR = [(100 + i, 1, 1 + i % 3) for i in range(30)] + [(2, 1, 5), (3, 2, 1), (3, 1, 2)]


@pytest.mark.parametrize(
    "options", [{}, {"fan": 4}, {"fan": 4, "q": 0.5}, {"q": 2.0}, {"hot_walkers": 1}, {"fan": 4, "hot_walkers": 1}]
)
def test_walks_follow_edges(spark, options):
    walks = random_walks(graph(spark, STAR), num_walks=3, length=12, **options).collect()
    allowed = {(a, b) for a, b, _ in STAR} | {(b, a) for a, b, _ in STAR}
    nodes = {n for e in allowed for n in e}
    assert Counter(w.start for w in walks) == {n: 3 for n in nodes}
    for w in walks:
        assert len(w.path) == 12 and w.path[0] == w.start
        assert all(step in allowed for step in zip(w.path, w.path[1:]))


def third_nodes(spark, edges, start, second, n, **options):
    walks = random_walks(graph(spark, edges), num_walks=n, length=3, **options).where(F.col("start") == start)
    return Counter(w.path[2] for w in walks.collect() if w.path[1] == second)


def share(counts, node):
    return counts[node] / sum(counts.values())


# 1 - 2, and from 2 to 1, 3 (also a neighbour of 1) and 4; unequal weights.
TRIANGLE = [(2, 1, 4), (3, 2, 1), (3, 1, 1), (4, 2, 3)]


@pytest.mark.parametrize("way", [{}, {"fan": 2}])
@pytest.mark.parametrize("p, q", [(2.0, 1.0), (0.5, 1.0), (2.0, 4.0), (0.25, 0.5)])
def test_second_order_chances(spark, way, p, q):
    counts = third_nodes(spark, TRIANGLE, 1, 2, 3000, p=p, q=q, **way)
    weight = {1: 4 / p, 3: 1.0, 4: 3 / q}
    for node, w in weight.items():
        assert abs(share(counts, node) - w / sum(weight.values())) < 0.04


def test_first_step_by_weight(spark):
    walks = random_walks(graph(spark, [(2, 1, 3), (3, 1, 1)]), num_walks=4000, length=2).where("start = 1").collect()
    assert abs(sum(w.path[1] == 2 for w in walks) / 4000 - 0.75) < 0.03


def test_walks_do_not_depend_on_partitioning(spark):
    a = random_walks(graph(spark, STAR), num_walks=2, length=8)
    b = random_walks(graph(spark, STAR).repartition(5), num_walks=2, length=8, hot_walkers=3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def rings(n, size):
    """Rings of nodes with chords, joined by one edge to the next ring, and two hubs that know a part of all."""
    edges = set()
    for r in range(n):
        at = 100 * r
        for i in range(size):
            edges |= {(at + i, at + (i + 1) % size), (at + i, at + (i + 3) % size)}
        edges.add((at, 100 * ((r + 1) % n) + 1))
        edges |= {(at + i, 9000 + i % 2) for i in range(0, size, 4)}
    edges.add((9000, 9001))
    return [(max(e), min(e), 1 + sum(e) % 4) for e in edges]


@pytest.mark.parametrize("p, q", [(2.0, 1.0), (1.0, 3.0)])
def test_walks_do_not_depend_on_placement(spark, p, q):
    edges = graph(spark, rings(6, 12))
    whole = random_walks(edges, num_walks=1, length=8, p=p, q=q, fan=8)
    parts = random_walks(edges, num_walks=1, length=8, p=p, q=q, fan=8, part_entries=60, hot_walkers=20)
    rows = lambda df: sorted((r.start, r.walk_no, tuple(r.path)) for r in df.collect())
    found = rows(whole)
    assert found == rows(parts)
    allowed = {e[:2] for e in rings(6, 12)} | {e[1::-1] for e in rings(6, 12)}
    assert all(len(path) == 8 and set(zip(path, path[1:])) <= allowed for _, _, path in found)


def test_placement_keeps_communities_together(spark):
    edges = [(a, b) for a, b, _ in rings(8, 12) if a < 9000]
    both = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "node bigint, nbr bigint, w double")
    loads = both.groupBy("node").agg(F.count("*").cast("double").alias("load"))
    placed = {r.node: r.part for r in place_nodes(both, loads, 60).collect()}
    assert len(placed) == 96
    load = Counter()
    for a, b in edges:
        load[placed[a]] += 1
        load[placed[b]] += 1
    assert len(load) > 1 and max(load.values()) <= 120
    cut = sum(placed[a] != placed[b] for a, b in edges) / len(edges)
    assert cut < 0.3  # at random it would be above 0.8


def test_pair_goes_back_and_forth(spark):
    walks = random_walks(graph(spark, [(2, 1, 1)]), num_walks=1, length=5).collect()
    assert sorted(tuple(w.path) for w in walks) == [(1, 2, 1, 2, 1), (2, 1, 2, 1, 2)]
