"""Nearest rows against brute force, oversampling."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.features import smote
from ledgerloom.operators.neighbours import nearest
from ledgerloom.session import materialize


def brute(q, p, k, cosine):
    hits = set()
    for i, x in q:
        scored = []
        for j, y in p:
            if i == j:
                continue
            if cosine:
                s = -round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6)
            else:
                s = round(float(np.linalg.norm(x - y)), 6)
            scored.append((s, j))
        hits |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(scored)[:k])}
    return hits


def frame(spark, rows, name):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], f"{name} bigint, vec array<double>")


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("way", ["few points", "few queries", "bounds"])
def test_ways_equal_brute_force(spark, way, cosine):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 4)), 1)
    x[100:180] = x[100]  # a third of the rows are copies
    rows = list(enumerate(x))
    asked = rows[::9] if way == "few queries" else rows
    small = {"few points": 1000, "few queries": 50, "bounds": 5}[way]
    got = nearest(frame(spark, asked, "qid"), frame(spark, rows, "pid"), 3, cosine, small_rows=small, group_rows=40)
    assert {(r.qid, r.pid, r["rank"]) for r in got.collect()} == brute(asked, rows, 3, cosine)


@pytest.mark.parametrize("small", [1000, 50, 5])
def test_large_values_and_small_distances(spark, small):
    rng = np.random.default_rng(8)
    far = rng.uniform(0, 2e9, size=(150, 2))
    close = 1e6 + rng.integers(0, 4000, size=(90, 2)) * 0.01
    rows = list(enumerate(np.concatenate([far, close])))
    asked = rows[::6] if small == 50 else rows
    got = nearest(frame(spark, asked, "qid"), frame(spark, rows, "pid"), 3, small_rows=small, group_rows=40)
    want = set()
    for i, x in asked:
        d = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in rows if j != i)
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(d[:3])}
    assert {(r.qid, r.pid, r["rank"]) for r in got.collect()} == want


def test_few_queries_give_one_row_a_task(spark):
    from ledgerloom.operators import neighbours as N

    points = frame(spark, list(enumerate(np.random.default_rng(1).normal(size=(25_000, 2)))), "pid").coalesce(1)
    few = N._collected(frame(spark, [(-1, np.zeros(2))], "qid"), "qid")
    assert points.mapInArrow(N._near_few_queries(few, 1, False), N._HITS).count() == 1


def test_fewer_points_than_wanted(spark):
    rows = list(enumerate(np.eye(3)))
    for small in (100, 1):
        got = nearest(frame(spark, rows, "qid"), frame(spark, rows, "pid"), 5, small_rows=small)
        assert got.groupBy("qid").count().where("count = 2").count() == 3


def test_zero_vector_has_no_direction(spark):
    rows = [(0, np.zeros(2)), (1, np.array([1.0, 0])), (2, np.array([1.0, 1]))]
    got = nearest(frame(spark, rows, "qid"), frame(spark, rows, "pid"), 5, cosine=True)
    assert {(r.qid, r.pid) for r in got.collect()} == {(1, 2), (2, 1)}


def test_oversampling_balances_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(5)
    minor = np.round(rng.normal(size=(40, 2)), 3)
    minor[:14] = minor[0]
    major = rng.normal(size=(230, 2)) + 5
    df = spark.createDataFrame(
        [([float(v) for v in x], 1) for x in minor] + [([float(v) for v in x], 0) for x in major], "x array<double>, y int"
    )
    made = [np.array(r.x) for r in smote(df, "x", "y", k=3).where("y = 1").collect()]
    assert len(made) == 190
    again = [np.array(r.x) for r in smote(df.repartition(7), "x", "y", k=3).collect()]
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))
    neighbours = {
        tuple(a): [minor[j] for j in np.argsort([np.linalg.norm(a - b) for b in minor])[: 14 if np.allclose(a, minor[0]) else 17]]
        for a in minor
    }
    for m in made:
        on_segment = any(
            abs(np.linalg.norm(m - a) + np.linalg.norm(m - b) - np.linalg.norm(np.array(a) - b)) < 1e-9
            for a, bs in neighbours.items() for b in bs
        )
        assert on_segment
    same = sum(np.allclose(m, minor[0]) for m in made)
    assert same >= 14 * 4  # copies are each other's nearest rows


def test_oversampling_of_copies_only(spark):
    df = spark.createDataFrame([([1.0], 1)] * 3 + [([float(i)], 0) for i in range(10)], "x array<double>, y int")
    made = smote(df, "x", "y").collect()
    assert len(made) == 7 and {tuple(r.x) for r in made} == {(1.0,)}


def test_equal_classes_need_nothing(spark):
    df = spark.createDataFrame([([1.0], 1), ([2.0], 0)], "x array<double>, y int")
    assert smote(df, "x", "y").count() == 0


def test_bytes_moved_grow_with_the_points(spark, monkeypatch):
    """Rows that meet the groups, at two sizes: the number of groups stays, so they grow with the points."""
    from ledgerloom.operators import neighbours as N

    moved = {}

    def counting(df, label):
        made = materialize(df, label)
        if label == "point-bytes":
            moved[size] = made.agg(F.sum(F.octet_length("codes"))).first()[0]
        return made

    monkeypatch.setattr(N, "materialize", counting)
    rng = np.random.default_rng(3)
    for size in (20_000, 80_000):
        rows = frame(spark, list(enumerate(np.round(rng.normal(size=(size, 8)), 2))), "pid")
        asked = frame(spark, [(10**6 + i, v) for i, v in enumerate(rng.normal(size=(300, 8)))], "qid")
        assert nearest(asked, rows, 2, small_rows=10).count() == 600
    assert moved[80_000] < 4.2 * moved[20_000] and moved[80_000] < 80_000 * 8 * 1.01


def test_bounds_hold_for_the_levels(spark):
    from ledgerloom.operators import neighbours as N

    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.normal(size=(500, 5)), rng.normal(size=(20, 5)) * 1e6])
    grid = N._Grid(rows[:200], 7)
    codes, off = grid.codes(rows)
    near = grid.decoded(codes)
    true = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    rough = np.sqrt(((near[:, None] - near[None]) ** 2).sum(2))
    spread = off[:, None] + off[None] + 1e-6
    assert (rough - spread <= true).all() and (true <= rough + spread).all()


class _Seen(Exception):
    pass


def test_points_meet_tasks_and_not_groups(spark, monkeypatch):
    """Bytes of points dealt to tasks do not grow when the groups of queries are smaller."""
    from ledgerloom.operators import neighbours as N

    def count(*_):
        def run(batches):
            sent = [sum(len(c) for c in b.column("codes").to_pylist()) for b in batches]
            yield pa.RecordBatch.from_pydict({"qid": pa.array([sum(sent)], pa.int64()), "pid": pa.array([0], pa.int64())})

        return run

    def look(df, label):
        if label == "possible":
            raise _Seen(df.agg(F.sum("qid")).first()[0])
        return materialize(df, label)

    monkeypatch.setattr(N, "_stream", count)
    monkeypatch.setattr(N, "materialize", look)
    rows = list(enumerate(np.random.default_rng(9).normal(size=(4000, 16))))
    sent = {}
    for group_rows in (4000, 40):
        with pytest.raises(_Seen) as seen:
            nearest(frame(spark, rows, "qid"), frame(spark, rows, "pid"), 3, small_rows=10, group_rows=group_rows)
        sent[group_rows] = seen.value.args[0]
    cores = spark.sparkContext.defaultParallelism
    assert sent[40] == sent[4000] <= (cores + 1) * 4000 * 16


def test_few_pairs_are_compared_in_full(spark, monkeypatch):
    """In many dimensions the two bytes leave little more than the neighbours themselves."""
    from ledgerloom.operators import neighbours as N

    left = []

    def look(df, label):
        made = materialize(df, label)
        if label == "possible":
            left.append(made.count())
        return made

    monkeypatch.setattr(N, "materialize", look)
    rows = list(enumerate(np.random.default_rng(10).normal(size=(3000, 64))))
    got = nearest(frame(spark, rows, "qid"), frame(spark, rows, "pid"), 3, True, small_rows=10)
    assert got.count() == 9000 and left[0] < 8 * 3000


def test_near_cells_far_rows_and_copies(spark, monkeypatch):
    """Many cells, groups that skip cells, rows far out, copies that fill a cell, queries of their own."""
    from ledgerloom.operators import neighbours as N

    monkeypatch.setattr(N, "CELL_ROWS", 40, raising=False)
    rng = np.random.default_rng(11)
    x = np.concatenate([np.round(rng.uniform(size=(2900, 2)), 2), rng.normal(size=(60, 2)) * 1e6, np.tile([[0.5, 0.5]], (540, 1))])
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(x)), x)]
    asked = rows[::7] + [(10**6 + i, v) for i, v in enumerate(rng.uniform(size=(50, 2)))]
    got = nearest(frame(spark, asked, "qid"), frame(spark, rows, "pid"), 4, small_rows=10, group_rows=30)
    ids, points = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = set()
    for i, v in asked:
        away = np.sqrt(((points - v) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, away)) if ids[j] != i][:4]
        want |= {(i, int(ids[j]), r + 1) for r, j in enumerate(order)}
    assert {(r.qid, r.pid, r["rank"]) for r in got.collect()} == want


def test_pairs_in_few_dimensions_grow_with_the_rows(spark, monkeypatch, tmp_path):
    """Groups meet near cells only: four times the rows make far fewer than sixteen times the comparisons."""
    from ledgerloom.operators import neighbours as N

    plain, log = N._Group.meet, str(tmp_path / "met")

    def meet(self, ids, *rest):
        with open(log + str(len(self.ids) * len(ids)) + "-" + str(id(rest)) + "-" + str(ids[0]) + "-" + str(self.ids[0]), "w"):
            pass
        return plain(self, ids, *rest)

    monkeypatch.setattr(N._Group, "meet", meet)
    monkeypatch.setattr(N, "CELL_ROWS", 100, raising=False)
    met = {}
    for size in (4000, 16_000):
        rows = list(enumerate(np.random.default_rng(size).uniform(size=(size, 2))))
        assert nearest(frame(spark, rows, "qid"), frame(spark, rows, "pid"), 3, small_rows=10, group_rows=4096).count() == 3 * size
        files = list(tmp_path.iterdir())
        met[size] = sum(int(f.name[3:].split("-")[0]) for f in files)
        for f in files:
            f.unlink()
    assert met[16_000] < 8 * met[4000]


def test_loose_bounds_hold_few_pairs():
    """A large group of one cell, whose first bound lets all pairs pass, lowers it before it holds them."""
    from ledgerloom.operators import neighbours as N

    x = np.random.default_rng(12).normal(size=(6000, 8))
    group = N._Group(np.arange(6000), x, np.full(6000, 1e-6), 4, 1e3)
    plain, most = group.thin, []
    group.thin = lambda: (most.append(group.held), plain())
    for at in range(0, 6000, 1000):
        group.meet(np.arange(at, at + 1000), x[at : at + 1000], np.full(1000, 1e-6))
    got = group.possible()
    assert max(most) < 40 * 6000
    away = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    pairs = set(zip(got["qid"].to_pylist(), got["pid"].to_pylist()))
    assert {(i, int(j)) for i in range(50) for j in np.argsort(away[i])[:4]} <= pairs and len(pairs) < 6 * 6000
