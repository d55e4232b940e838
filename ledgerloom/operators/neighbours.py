"""Exact nearest rows by Euclidean distance or cosine, for any number of rows.

Three ways give the same answer, chosen by measured size:

* few points: they are sent to every task, queries stay where they are;
* few queries: they are sent to every task, each task keeps the best ``k`` per
  query of all its points, and those are merged;
* many of both: a file of vector approximations. Each number of a vector becomes
  one byte, the nearest of 256 levels of its dimension, and a second byte for what
  is left, in steps of the largest such rest of its vector; each vector keeps the
  distance to what its bytes stand for. Two such distances and that between the
  approximations bound the distance of a pair from both sides. Bytes of points,
  packed where they are read, stream past the queries; a pair whose lower bound is
  above the k-th upper bound of its query is out, and the few that stay are
  compared in full.

In the third way, points that are equal in all numbers are one, with the ids that
can matter, and so are queries. Both lie in cells around sampled pivots. Whole cells
of queries, near ones together, are dealt to about as many tasks as there are
cores, and the bytes of a cell of points go once to each task that may need
them; so what moves grows with the points and not with the pairs, until the queries
of a task are too many to hold; then there are more tasks. Inside a task, groups of
queries of one cell skip the cells that the triangle inequality rules out.

Blocks are compared by matrix products of centred rows. Pairs that these leave
possible, with their rounding, are compared again from differences, so large
values and small distances rank right.

Inputs are ``queries(qid bigint, vec array<double>)`` and
``points(pid bigint, vec array<double>)`` with unique ids and vectors of one
length; a query never finds the point of its own id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.operators.joins import is_small
from ledgerloom.session import materialize

SMALL_ROWS = 20_000
SMALL_BYTES = 64 * 1024 * 1024
#: Share of the data's extent by which computed distances may be off.
SLACK = 1e-6
_DIGITS = 6
_PAIRS = 1 << 20
_HITS = "qid bigint, pid bigint, score double"


# Queries compared at a time.
GROUP_ROWS = 200_000
# Cells: at most so many, of so many points.
CELLS, CELL_ROWS = 4096, 1000
# Bytes of the queries that a task holds, of the rows it packs, and of the points that it puts off.
TASK_BYTES, BUFFER_BYTES = 256 << 20, 32 << 20
# Bytes of a packed row; levels of a dimension, and rows they are fitted on.
PACKED_BYTES, LEVELS, SAMPLE = 8192, 256, 4096
# Pairs compared at a time.
_AT_ONCE = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _as_batch(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, preserve_index=False)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of centred rows, and by how much each row of ``a`` may be off."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    square = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    return np.maximum(square, 0.0), 64 * a.shape[1] * np.finfo(float).eps * (aa + bb.max(initial=0.0))


def _exact(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """Score of row i of ``a`` with row i of ``b``; smaller is better for both kinds."""
    out = np.empty(len(a))
    for at in range(0, len(a), _PAIRS // max(a.shape[1], 1) + 1):
        part = slice(at, at + _PAIRS // max(a.shape[1], 1) + 1)
        out[part] = -(a[part] * b[part]).sum(1) if cosine else np.sqrt(((a[part] - b[part]) ** 2).sum(1))
    return out


def _keep(q_ids: np.ndarray, p_ids: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """First ``k`` hits of each query by score, then id."""
    order = np.lexsort((p_ids, score, q_ids))
    q_ids, p_ids, score = q_ids[order], p_ids[order], score[order]
    first = np.flatnonzero(np.diff(q_ids, prepend=np.nan)) if len(q_ids) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(q_ids)))
    top = np.arange(len(q_ids)) - np.repeat(first, size) < k
    return pd.DataFrame({"qid": q_ids[top], "pid": p_ids[top], "score": score[top]})


def _best(q_ids, q, p_ids, p, k: int, cosine: bool) -> pd.DataFrame:
    """Best ``k`` points per query of two blocks; scores are distances, or cosines with a minus."""
    if not len(q_ids) or not len(p_ids):
        return pd.DataFrame({"qid": np.zeros(0, np.int64), "pid": np.zeros(0, np.int64), "score": np.zeros(0)})
    if cosine:
        rough, off = -(q @ p.T), np.full(len(q), 64 * q.shape[1] * np.finfo(float).eps)
    else:
        rough, off = _squares(q, p)
    order = np.argsort(p_ids, kind="stable")
    spot = order[np.minimum(np.searchsorted(p_ids[order], q_ids), len(p_ids) - 1)]
    own = np.flatnonzero(p_ids[spot] == q_ids)
    rough[own, spot[own]] = np.inf
    few = min(k, len(p_ids)) - 1
    bar = np.partition(rough, few, axis=1)[:, few] + 2 * off
    parts = []
    step = max(1, _PAIRS // len(p_ids))
    for at in range(0, len(q_ids), step):
        i, j = np.nonzero((rough[at : at + step] <= bar[at : at + step, None]) & np.isfinite(rough[at : at + step]))
        i += at
        parts.append(_keep(q_ids[i], p_ids[j], _exact(q[i], p[j], cosine), k))
    return pd.concat(parts, ignore_index=True)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("score", "pid")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _output(hits: DataFrame, cosine: bool) -> DataFrame:
    return hits.withColumn("score", F.round(-F.col("score") if cosine else F.col("score"), _DIGITS))


def _collected(df: DataFrame, id_col: str):
    rows = df.select(id_col, "vec").toArrow()
    return df.sparkSession.sparkContext.broadcast((rows[id_col].to_numpy().astype(np.int64), _matrix(rows["vec"])))


def _near_few_points(few, k: int, cosine: bool):
    def run(batches):
        ids, matrix = few.value
        for batch in batches:
            if len(batch) and len(ids):
                yield _as_batch(_best(batch.column(0).to_numpy(), _matrix(batch.column("vec")), ids, matrix, k, cosine))

    return run


def _near_few_queries(few, k: int, cosine: bool):
    """One row per query and hit from each task, however many batches it reads."""

    def run(batches):
        ids, matrix = few.value
        held = None
        for batch in batches:
            if len(batch) and len(ids):
                hits = _best(ids, matrix, batch.column(0).to_numpy(), _matrix(batch.column("vec")), k, cosine)
                both = hits if held is None else pd.concat([held, hits])
                held = _keep(both.qid.to_numpy(), both.pid.to_numpy(), both.score.to_numpy(), k)
        if held is not None:
            yield _as_batch(held)

    return run


def _unit(df: DataFrame) -> DataFrame:
    """Vectors of length 1; a zero vector has no direction and is left out."""
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("_size", size).where(F.col("_size") > 0).withColumn(
        "vec", F.transform("vec", lambda x: x / F.col("_size"))
    ).drop("_size")


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    cosine: bool = False,
    small_rows: int = SMALL_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(qid, pid, score, rank): the ``k`` nearest points of each query, rank from 1.

    Ranks follow the full scores, equal ones the id. The scores returned are
    distances, or cosines with ``cosine``, rounded to 6 decimals.
    """
    as_double = F.col("vec").cast("array<double>").alias("vec")
    given = queries.select(F.col("qid").cast("bigint").alias("qid"), "vec"), points.select(F.col("pid").cast("bigint").alias("pid"), "vec")
    queries, points = given[0].select("qid", as_double), given[1].select("pid", as_double)
    if cosine:
        queries, points = _unit(queries), _unit(points)
    if is_small(points, small_rows, SMALL_BYTES):
        found = queries.mapInArrow(_near_few_points(_collected(points, "pid"), k, cosine), _HITS)
    elif is_small(queries, min(small_rows, 2000), SMALL_BYTES):
        found = points.select("pid", "vec").mapInArrow(_near_few_queries(_collected(queries, "qid"), k, cosine), _HITS)
    else:
        found = _by_bounds(*given, k, cosine, group_rows)
    return _output(_ranked(found, k), cosine)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, b)[0])


class _Grid:
    """Pivots, and for each dimension the ascending levels that a byte stands for; fitted on a sample."""

    def __init__(self, sample: np.ndarray, pivots: int):
        self.pivots = np.unique(sample[:pivots], axis=0)
        at = (np.arange(LEVELS) + 0.5) / LEVELS
        self.levels = np.quantile(sample, at, axis=0)
        self.middles = (self.levels[1:] + self.levels[:-1]) / 2

    @classmethod
    def of(cls, kept: dict) -> _Grid:
        """The grid of what a broadcast holds: arrays, since a class would have to be installed on executors."""
        grid = cls.__new__(cls)
        grid.__dict__.update(kept)
        return grid

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte a number, and the distance of each row to what its bytes stand for."""
        out = np.empty(rows.shape, np.uint8)
        for d in range(rows.shape[1]):
            out[:, d] = np.searchsorted(self.middles[:, d], rows[:, d])
        return out, np.sqrt(((rows - self.decoded(out)) ** 2).sum(1)) * (1 + 1e-9)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.levels, codes.astype(np.int64), axis=0)

    def rests(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A second byte a number, the step it counts in, and the distance of each row to what both bytes stand for."""
        rest = rows - self.decoded(codes)
        step = np.abs(rest).max(axis=1, initial=0.0) / 127
        fine = np.rint(rest / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8)
        return fine, step, np.sqrt(((rows - self.refined(codes, fine, step)) ** 2).sum(1)) * (1 + 1e-9)

    def refined(self, codes: np.ndarray, fine: np.ndarray, step: np.ndarray) -> np.ndarray:
        return self.decoded(codes) + fine * step[:, None]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot and the distance to it."""
        cell = np.empty(len(rows), np.int64)
        size = max(1, _AT_ONCE // len(self.pivots))
        for at in range(0, len(rows), size):
            cell[at : at + size] = _far(rows[at : at + size], self.pivots).argmin(1)
        return cell, _exact(rows, self.pivots[cell], False)

    def apart(self, cell: int) -> np.ndarray:
        """Distances of a pivot to all pivots."""
        return _exact(np.broadcast_to(self.pivots[cell], self.pivots.shape), self.pivots, False)

    def slack(self, radius):
        """By how much computed distances of cells may be off."""
        return SLACK * (np.abs(self.pivots).max(initial=0.0) * self.pivots.shape[1] + radius)


_PIECE = ["ids", "codes", "fine", "step", "off"]
_PACK = "cell int, n int, radius double, " + ", ".join(f"{c} binary" for c in _PIECE)


def _pack(grid):
    """Rows (id, vec) of one cell packed into rows of bounded bytes, made where the rows are read."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        cell, away, *columns = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cell, kind="stable")
        size = max(1, PACKED_BYTES // (columns[1].shape[1] + 16))
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            for at in range(0, len(part), size):
                own = part[at : at + size]
                out.append((int(cell[own[0]]), len(own), float(away[own].max()), *(c[own].tobytes() for c in columns)))
        kinds = (pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * len(columns))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _PACK.split(", ")]
        )

    def run(batches):
        own, held, size = _Grid.of(grid.value), [], 0
        for batch in batches:
            if not len(batch):
                continue
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column("vec"))
            codes, _ = own.codes(rows)
            fine, step, off = own.rests(rows, codes)
            held.append((*own.cells(rows), ids, codes, fine, step, off))
            size += sum(x.nbytes for x in held[-1])
            if size > BUFFER_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


class _Group:
    """Queries of one cell: decoded rows, bounds so far, and pairs that are still possible."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, off: np.ndarray, k: int, bound: float = np.inf):
        self.ids, self.rows, self.off, self.k = ids, rows, off, k
        self.bound = np.full(len(ids), bound)
        self.top = bound
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.kept = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, off: np.ndarray) -> None:
        """Compare all queries with some points."""
        step = max(1, _AT_ONCE // len(ids))
        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            square, slack = _squares(self.rows[part], rows)
            # the square root of the rounding bounds the error of the root
            most = off.max() + self.off[part] + np.sqrt(slack)
            hit = square <= self._limit(part, most)
            if len(ids) >= self.k and np.count_nonzero(hit) > 8 * self.k * len(hit):
                kth = np.partition(square, self.k - 1, axis=1)[:, self.k - 1]
                self.bound[part] = np.minimum(self.bound[part], np.sqrt(kth) + most)
                hit = square <= self._limit(part, most)
            i, j = np.nonzero(hit)
            far = np.sqrt(square[i, j])
            spread = self.off[part][i] + off[j] + np.sqrt(slack)[i]
            self.pairs.append((i + at, ids[j], far - spread, far + spread))
            self.held += len(i)
            if self.held > max(4 * self.k * len(self.ids) + 4096, 2 * self.kept):
                self.thin()

    def _limit(self, part: slice, most: np.ndarray) -> np.ndarray:
        """The squared distance above which a pair is out."""
        return ((self.bound[part] + most) ** 2 * (1 + 1e-12))[:, None]

    def thin(self) -> None:
        """Lower the bounds to the k-th upper bound of the pairs, and keep those that are still possible."""
        if not self.pairs:
            return
        i, j, low, high = (np.concatenate(x) for x in zip(*self.pairs))
        order = np.lexsort((high, i))
        first = np.searchsorted(i[order], np.arange(len(self.ids)))
        last = first + self.k - 1
        there = last < np.append(first[1:], len(order))
        self.bound[there] = np.minimum(self.bound[there], high[order][last[there]])
        self.top = self.bound.max(initial=0.0)
        ok = low <= self.bound[i]
        self.pairs = [(i[ok], j[ok], low[ok], high[ok])]
        self.held = self.kept = int(ok.sum())

    def possible(self) -> pa.RecordBatch:
        self.thin()
        i, j = self.pairs[0][:2] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(j)], ["qid", "pid"])


def _read(grid: _Grid, pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, decoded rows and their distances to the true ones, of packed pieces."""
    kinds = (np.int64, np.uint8, np.int8, np.float64, np.float64)
    ids, codes, fine, step, off = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*pieces), kinds))
    codes, fine = codes.reshape(len(ids), -1), fine.reshape(len(ids), -1)
    return ids, grid.refined(codes, fine, step), off


class _Task:
    """The groups of queries of one task, by cell, and the points they have yet to meet."""

    def __init__(self, grid: _Grid, k: int, group_rows: int):
        self.grid, self.k, self.group_rows = grid, k, group_rows
        self.groups: dict[int, list[_Group]] = {}
        self.reach: dict[int, tuple[float, np.ndarray]] = {}
        self.waiting: list[tuple[int, float, list[tuple]]] = []
        self.size = 0

    def ask(self, cell: int, radius: float, bound: float, pieces: list[tuple]) -> None:
        ids, rows, off = _read(self.grid, pieces)
        made = [
            _Group(ids[at : at + self.group_rows], rows[at : at + self.group_rows], off[at : at + self.group_rows], self.k, bound)
            for at in range(0, len(ids), self.group_rows)
        ]
        self.groups[cell] = made
        self.reach[cell] = (radius + self.grid.slack(radius), self.grid.apart(cell))

    def meet(self, cell: int, radius: float, pieces: list[tuple], homes) -> None:
        points = None
        for home in homes:
            own, apart = self.reach[home]
            least = apart[cell] - own - radius
            for group in self.groups[home]:
                if least <= group.top:
                    points = points or _read(self.grid, pieces)
                    group.meet(*points)

    def take(self, cell: int, radius: float, pieces: list[tuple]) -> None:
        """Queries of the same cell meet the points now, and others when their bounds are near."""
        if cell not in self.groups:
            self.catch_up()
            self.meet(cell, radius, pieces, self.groups)
            return
        self.meet(cell, radius, pieces, [cell])
        self.waiting.append((cell, radius, pieces))
        self.size += sum(len(x) for p in pieces for x in p)
        if self.size > TASK_BYTES // 8:
            self.catch_up()

    def catch_up(self) -> None:
        if self.waiting:
            for cell, groups in self.groups.items():
                for group in groups:
                    group.thin()
            for cell, radius, pieces in self.waiting:
                self.meet(cell, radius, pieces, [h for h in self.groups if h != cell])
            self.waiting, self.size = [], 0

    def possible(self):
        self.catch_up()
        for groups in self.groups.values():
            for group in groups:
                yield group.possible()


def _stream(grid, k: int, group_rows: int):
    """Possible pairs of each task: its queries come first, then points of their cells, then others, nearest first."""

    def run(batches):
        deck, task, run_of, held = None, None, None, []

        def close():
            if held:
                side, cell, radius, bound = run_of[1], run_of[2], max(p[0] for p in held), held[0][1]
                pieces = [p[2:] for p in held]
                if side == 0:
                    task.ask(cell, radius, bound, pieces)
                elif task.groups:  # none if no query was dealt here
                    task.take(cell, radius, pieces)
                held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("deck", "side", "cell", "radius", "bound", *_PIECE)]
            for at, side, cell, *piece in zip(*columns):
                if (at, side, cell) != run_of or (side > 0 and len(held) >= 16):
                    close()
                    if at != deck:
                        if task is not None:
                            yield from task.possible()
                        deck, task = at, _Task(_Grid.of(grid.value), k, group_rows)
                    run_of = (at, side, cell)
                held.append(tuple(piece))
        close()
        if task is not None:
            yield from task.possible()

    return run


def _in_line(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order that keeps near ones together: halved by the widest dimension, again and again."""
    todo, out = [np.arange(len(pivots))], []
    while todo:
        own = todo.pop()
        if len(own) <= 2:
            out.append(own)
            continue
        rows = pivots[own]
        own = own[np.argsort(rows[:, np.ptp(rows, axis=0).argmax()], kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out)


def _deal(grid: _Grid, here: pd.DataFrame, there: pd.DataFrame, k: int, decks: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Decks of the parts of each cell of queries, and the decks that a cell of points goes to."""
    limit = max(1, ceil(here.n.sum() / (4 * decks)))
    share, dealt = max(1, here.n.sum() / decks), 0
    points, radii, counts = there.index.to_numpy(), there.radius.to_numpy(), there.n.to_numpy()
    parts = []
    near = np.full((decks, len(points)), np.inf)  # from the cells of points to the nearest of a deck that may need them
    for home in _in_line(grid.pivots):
        if home not in here.index:
            continue
        radius, rows = here.radius[home], here.n[home]
        apart = grid.apart(home)[points]
        reach = apart + radius + radii
        order = np.argsort(reach)
        # cells that hold k + 1 points for sure bound the k-th distance of every query of the cell
        enough = np.searchsorted(np.cumsum(counts[order]), k + 1)
        bound = (reach[order[enough]] if enough < len(order) else np.inf) + grid.slack(radius)
        met = apart - radius - radii <= bound
        split = ceil(rows / limit)
        for part in range(split):
            deck = min(decks - 1, int(dealt / share))
            dealt += rows / split
            parts.append((int(home), part, split, deck, float(radius), float(bound)))
            near[deck, met] = np.minimum(near[deck, met], apart[met])
    deck, spot = np.nonzero(np.isfinite(near))
    homes = {(p[0], p[3]) for p in parts}
    side = [1 if (c, d) in homes else 2 for c, d in zip(points[spot].tolist(), deck.tolist())]
    return (
        pd.DataFrame(parts, columns=["cell", "part", "split", "deck", "far", "bound"]),
        pd.DataFrame({"cell": points[spot], "deck": deck, "side": side, "low": near[deck, spot]}),
    )


def _rescore(cosine: bool):
    def run(batches):
        for batch in batches:
            score = _exact(_matrix(batch.column("q")), _matrix(batch.column("p")), cosine)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("pid"), pa.array(score)], ["qid", "pid", "score"])

    return run


def _with_hashes(df: DataFrame, id_col: str, unit, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each, and apart from their vectors two hashes of each; -0.0 is 0.0."""
    held = unit(materialize(df.withColumn("row", F.monotonically_increasing_id()), label))
    plain = F.transform("vec", lambda x: x + 0.0)
    hashes = held.select("row", id_col, F.xxhash64(F.lit(1), plain).alias("lo"), F.xxhash64(F.lit(2), plain).alias("hi"))
    return held, materialize(hashes, f"{label}-hashes")


def _once(held: DataFrame, hashes: DataFrame, id_col: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with equal vectors that of least id, and the hashes of these; vectors move only if many are equal."""
    first = hashes.groupBy("lo", "hi").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "row")).alias("one"))
    first = materialize(first.select("lo", "hi", f"one.{id_col}", "one.row"), f"{label}-first")
    copies = materialize(hashes.select("row").join(first.select("row"), "row", "left_anti"), f"{label}-copies")
    return held.join(copies, "row", "left_anti").select(id_col, "vec"), first


def _by_bounds(queries: DataFrame, points: DataFrame, k: int, cosine: bool, group_rows: int) -> DataFrame:
    spark = points.sparkSession

    def unit(df: DataFrame) -> DataFrame:
        df = df.withColumn("vec", F.col("vec").cast("array<double>"))
        return _unit(df) if cosine else df

    all_points, marks = _with_hashes(points, "pid", unit, "points")
    all_queries, asked = _with_hashes(queries, "qid", unit, "queries")
    once, keys = _once(all_points, marks, "pid", "points")
    first, heads = _once(all_queries, asked, "qid", "queries")
    # Of points that are equal, the k + 1 of least id can be among the k nearest of a query.
    twins = Window.partitionBy("lo", "hi").orderBy("pid")
    few = materialize(marks.withColumn("_n", F.row_number().over(twins)).where(F.col("_n") <= k + 1).drop("_n"), "point-ids")
    n = keys.count()
    # A bounded sample: it decides how much is moved and compared, not the answer.
    some = keys.select("pid").orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE)
    sample = once.join(F.broadcast(some), "pid", "left_semi").toArrow().sort_by("pid") if n else None
    cores = spark.sparkContext.defaultParallelism
    rows = _matrix(sample["vec"]) if n else np.zeros((1, 1))
    rows = rows[np.random.default_rng(0).permutation(len(rows))]
    fitted = _Grid(rows, max(1, min(CELLS, n // CELL_ROWS)))
    grid = spark.sparkContext.broadcast(vars(fitted))
    blocks = materialize(once.mapInArrow(_pack(grid), _PACK), "point-bytes")
    groups = materialize(first.mapInArrow(_pack(grid), _PACK), "query-bytes")

    def cells(df: DataFrame):
        """Radius and rows of each cell; as many rows as pivots."""
        found = df.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).toPandas().set_index("cell")
        return found.sort_index()

    here, there = cells(groups), cells(blocks)
    decks = max(cores, ceil(here.n.sum() * (8 * rows.shape[1] + 64) / TASK_BYTES))
    dealt, routes = _deal(fitted, here, there, k, decks)
    parts = spark.createDataFrame(dealt, "cell int, part int, split int, deck int, far double, bound double")
    ways = spark.createDataFrame(routes, "cell int, deck int, side int, low double")
    chosen = F.pmod(F.xxhash64("ids"), F.col("split")) == F.col("part")
    own = groups.join(F.broadcast(parts), "cell").where(chosen).select(
        "deck", F.lit(0).alias("side"), F.lit(0.0).alias("low"), "cell", F.col("far").alias("radius"), "bound", *_PIECE
    )
    far = blocks.join(F.broadcast(ways), "cell").select(
        "deck", "side", "low", "cell", "radius", F.lit(None).cast("double").alias("bound"), *_PIECE
    )
    stream = own.unionByName(far).repartitionById(decks, F.col("deck")).sortWithinPartitions("deck", "side", "low", "cell")
    possible = materialize(stream.mapInArrow(_stream(grid, k + 1, group_rows), "qid bigint, pid bigint"), "possible")
    # what the bounds leave is compared in full, once for equal vectors, then ids are put back
    pairs = possible.join(once.select("pid", F.col("vec").alias("p")), "pid").join(first.select("qid", F.col("vec").alias("q")), "qid")
    scored = pairs.select("qid", "pid", "q", "p").mapInArrow(_rescore(cosine), _HITS)
    scored = materialize(_ranked(scored, k + 1).select("qid", "pid", "score"), "scored")
    reps = keys.select(F.col("pid").alias("rep"), "lo", "hi")
    ids = few.select("lo", "hi", "pid")
    full = scored.withColumnRenamed("pid", "rep").join(reps, "rep").join(ids, ["lo", "hi"]).select("qid", "pid", "score")
    full = materialize(_ranked(full, k + 1).select(F.col("qid").alias("rep"), "pid", "score"), "ranked")
    back = asked.select("qid", "lo", "hi").join(heads.select(F.col("qid").alias("rep"), "lo", "hi"), ["lo", "hi"]).select("qid", "rep")
    return back.join(full, "rep").where("qid <> pid").select("qid", "pid", "score")
