"""Near-duplicate vectors by E8 lattice hashing.

1. Rows with equal label and vector are one class from here on. Random
   rotations of the unit vectors are cut into eight tables of sixteen
   dimensions, each of two blocks of eight, and a block, scaled, is decoded to
   its nearest point of the lattice E8. A cell is a label, a table and two points.
2. A vector enters its own cell and probes every neighbouring cell whose border
   is nearer than a share of half the distance that two vectors at the threshold
   have in a table. Two vectors that share a cell of any table are compared.
3. Of a cell that two classes share, each member learns the least one; the
   least of all its cells is its leader. Members of one leader are a group, and
   two groups are compared once, when some cell holds members of both. So rows
   grow with cells and groups, not with the pairs inside a cell.
4. Groups are cut into pieces of bounded size. A task takes two pieces and
   verifies every cosine in double precision; it returns, for each vector, the
   number of rows it links with and the least vector of its links in the task.
5. Classes are the connected components of these links.

In 64 dimensions a pair exactly at the threshold shares no cell of one table
with chance 0.1, of all tables with 1e-8, and a vector enters 46 cells. The
scale of the lattice grows with the sixteenth root of the largest label, so that
cells hold about as many unrelated vectors at every size; at a thousand times as
many vectors the chance of a miss is about 1e-6.

Cases: a vector that is null, empty or zero, or holds nulls, infinities or NaN,
a row without label, and a row without id are linked with nothing; vectors of
different lengths are not compared; every row counts, so repeated rows link with
each other, and rows that share an id and differ in vector are judged one by
one; other columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.near_dedup import _Tables, components
from ledgerloom.llm.words import mix, ragged
from ledgerloom.session import drop_path, scratch_path

BLOCK, TABLE, TABLES = 8, 16, 8
# Scale of the lattice in 64 dimensions for labels of this many different vectors.
SCALE, AT = 5.0, 5000
# Share of half the distance at the threshold within which cells are probed.
SHARE = 0.35
# Pieces of a group: of so many members, expected, up to a number of pieces; then pieces grow up to the second bound.
PIECE, PIECES, LARGEST = 128, 32, 4096
_CHUNK = 1024


def neighbours() -> np.ndarray:
    """Lattice vectors of E8 up to length 2: zero, 240 of length sqrt(2), 2160 of length 2."""
    roots = [
        [a if k == i else b if k == j else 0 for k in range(BLOCK)]
        for i, j in combinations(range(BLOCK), 2) for a in (1, -1) for b in (1, -1)
    ]
    roots += [h for h in product((0.5, -0.5), repeat=BLOCK) if sum(x < 0 for x in h) % 2 == 0]
    roots = np.array(roots)
    sums = np.unique((roots[:, None] + roots[None]).reshape(-1, BLOCK), axis=0)
    return np.concatenate((np.zeros((1, BLOCK)), *(sums[(sums**2).sum(1) == n] for n in (2, 4))))


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points whose coordinates have an even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.argmax(np.abs(rest[odd]), 1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 for every row of eight coordinates."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def projections(dims: int) -> list[np.ndarray]:
    """One matrix for each table: columns of random rotations, the same in every task."""
    out: list[np.ndarray] = []
    draw = np.random.default_rng(8)
    while len(out) < TABLES:
        q, r = np.linalg.qr(draw.normal(size=(dims, dims)))
        turn = np.zeros((dims, -(-dims // TABLE) * TABLE))
        turn[:, :dims] = q * np.sign(np.diag(r))
        out += np.split(turn, turn.shape[1] // TABLE, axis=1)
    return out[:TABLES]


def _touched(x: np.ndarray, near: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that a ball around each row of ``x`` may touch: row, hash of the cell, least squared distance to it."""
    weights = mix(np.arange(1, BLOCK + 1)) | np.uint64(1)
    with np.errstate(over="ignore"):
        code = lambda points: ((2 * points).astype(np.int64).view(np.uint64) * weights).sum(1)
        point = decode(x)
        length = np.sqrt((near[1:] ** 2).sum(1))
        # distance to the plane half-way to the neighbour
        away = (length**2 / 2 - (x - point) @ near[1:].T) / length
        row, which = np.nonzero(away <= reach)
        rows = np.concatenate((np.arange(len(x)), row))
        cell = np.concatenate((code(point), code(point)[row] + code(near)[1 + which]))
    return rows, cell, np.concatenate((np.zeros(len(x)), np.maximum(away[row, which], 0) ** 2))


def cells(unit: np.ndarray, salt: np.ndarray, threshold: float, grown: float, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``unit`` and the keys of the cells they enter, of all tables; ``near`` holds the neighbours of a cell."""
    dims = unit.shape[1]
    scale = SCALE * np.sqrt(max(dims, TABLE) / 64) * grown
    reach = SHARE * scale * np.sqrt((2 - 2 * threshold) * min(1.0, TABLE / dims)) / 2
    shifts = np.random.default_rng(9).random((TABLES, TABLE))
    found = []
    for t, (matrix, shift) in enumerate(zip(projections(dims), shifts)):
        turned = unit @ matrix * scale + shift
        halves = []
        for a in (0, BLOCK):
            row, cell, away = _touched(turned[:, a : a + BLOCK], near, reach)
            order = np.argsort(row, kind="stable")
            halves.append((row[order], cell[order], away[order], np.bincount(row, minlength=len(unit))))
        (row, first, away, _), (_, second, away2, count) = halves
        begin = np.cumsum(count) - count
        i = np.repeat(np.arange(len(row)), count[row])
        j = ragged(begin[row], count[row])
        ok = away[i] + away2[j] <= reach * reach
        i, j = i[ok], j[ok]
        with np.errstate(over="ignore"):
            key = mix(mix(first[i] + salt[row[i]]) + second[j] + mix(np.array([t + 1])))
        found.append((row[i], key))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # squares stay finite
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: indices and matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    begin = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        out.append((own, flat[ragged(begin[own], np.full(len(own), d))].reshape(len(own), d)))
    return out


def _enter(threshold: float, grown: float):
    """Cells of every class."""

    def run(batches):
        near = neighbours()
        for batch in batches:
            for at in range(0, len(batch), _CHUNK):
                part = batch.slice(at, _CHUNK)
                ids = part.column("k").to_numpy()
                salt = mix(part.column("h").to_numpy().view(np.uint64))
                for own, vectors in _by_length(part.column("vector")):
                    row, key = cells(_unit(vectors), salt[own], threshold, grown, near)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[own][row])], ["cell", "k"])

    return run


def local_links(vectors: np.ndarray, others: np.ndarray | None, threshold: float):
    """Which rows of ``vectors`` link with which of ``others``, or with later ones of their own."""
    a = _unit(vectors)
    b = a if others is None else _unit(others)
    i, j = np.nonzero(a @ b.T >= threshold)
    if others is None:
        return i[i < j], j[i < j]
    return i, j


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(threshold: float):
    """Links of the two pieces of every pair; rows arrive sorted by pair and side."""

    def judge(table):
        k, copies, side = (table.column(c).to_numpy() for c in ("k", "copies", "side"))
        split = int((side == 0).sum())
        i, j = [], []
        column = table.column("vector").combine_chunks()
        sizes = np.asarray(column.value_lengths())
        flat = np.asarray(column.flatten())
        begin = np.cumsum(sizes) - sizes
        take = lambda own, d: flat[ragged(begin[own], np.full(len(own), d))].reshape(len(own), d)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            left, right = own[own < split], own[own >= split]
            if split == len(k):
                a, b = local_links(take(own, d), None, threshold)
                i.append(own[a]), j.append(own[b])
            elif len(left) and len(right):
                a, b = local_links(take(left, d), take(right, d), threshold)
                i.append(left[a]), j.append(right[b])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
        linked = np.zeros(len(k), np.int64)
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        order = np.argsort(k)  # so that the least place is the least key
        place = np.empty(len(k), np.int64)
        place[order] = np.arange(len(k))
        root = k[order][least_reachable(len(k), place[i], place[j])][place]
        some = linked > 0
        return k[some], linked[some], root[some]

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("a", "pa", "b", "pb")]
            edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
            out = [judge(held.slice(s, e - s)) for s, e in zip([0, *edges[:-1]], edges)]
            if len(edges):
                held = held.slice(int(edges[-1]))
                yield _links(out)
        if held is not None:
            yield _links([judge(held)])

    return run


def _links(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["k", "linked", "root"])


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    tables = _Tables(spark)
    keep = tables.keep
    vector = F.col(vector_col)
    sound = (
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    )
    # a label and a vector are known by two hashes; -0.0 is 0.0
    plain = F.transform(vector, lambda x: x + 0.0 * x)
    source = vectors.select(
        F.col(id_col).alias("id"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64(F.lit("label"), label_col).alias("h"),
        F.xxhash64(F.lit(1), label_col, plain).alias("lo"), F.xxhash64(F.lit(2), plain, label_col).alias("hi"), vector.alias("vector"),
    )
    classes = keep(
        source.where("sound").groupBy("lo", "hi")
        .agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("h").alias("h"), F.first("vector").alias("vector"))
        .withColumn("k", F.monotonically_increasing_id())
    )
    most = classes.groupBy("h").count().agg(F.max("count")).first()[0] or 1
    grown = (most / AT) ** (1 / TABLE)
    entered = keep(classes.select("k", "h", "vector").mapInArrow(_enter(threshold, grown), "cell long, k long"))
    shared = keep(
        entered.groupBy("cell").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("cell", "first")
    )
    members = keep(entered.join(shared, "cell"))
    leaders = keep(members.groupBy("k").agg(F.min("first").alias("leader")))
    sizes = leaders.groupBy("leader").agg(F.count("*").alias("size"))
    parts = F.greatest(F.least(F.ceil(F.col("size") / PIECE), F.lit(PIECES)), F.ceil(F.col("size") / LARGEST))
    placed = keep(
        leaders.join(sizes, "leader")
        .select("k", "leader", F.pmod(F.xxhash64("k"), parts).cast("int").alias("piece"))
        .join(classes.select("k", "copies", "vector"), "k")
    )
    # groups that meet in a cell, each with itself
    met = keep(members.join(leaders, "k").select("cell", "leader").distinct())
    groups = met.select("cell", F.col("leader").alias("a")).join(met.select("cell", F.col("leader").alias("b")), "cell").where("a <= b")
    pieces = keep(placed.groupBy("leader", "piece").agg(F.count("*").alias("n")))
    left, right = (pieces.select(F.col("leader").alias(x), F.col("piece").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = keep(
        groups.select("a", "b").distinct().join(left, "a").join(right, "b")
        .where("a < b or pa < pb or (pa = pb and na > 1)").select("a", "pa", "b", "pb")
    )
    sides = None
    for side, (lead, piece) in enumerate((("a", "pa"), ("b", "pb"))):
        wanted = pairs if side == 0 else pairs.where("a < b or pa < pb")
        found = wanted.join(placed, (F.col(lead) == F.col("leader")) & (F.col(piece) == F.col("piece"))).select(
            "a", "pa", "b", "pb", F.lit(side).alias("side"), "k", "copies", "vector"
        )
        sides = found if sides is None else sides.union(found)
    links = keep(
        sides.repartition("a", "pa", "b", "pb").sortWithinPartitions("a", "pa", "b", "pb", "side")
        .mapInArrow(_compare(threshold), "k long, linked long, root long")
    )
    reached = components(links.where("k <> root").select(F.col("k").alias("u"), F.col("root").alias("c")), keep)
    counts = links.groupBy("k").agg(F.sum("linked").alias("linked"))
    named = keep(
        classes.select("lo", "hi", "k", "copies", "least").join(counts, "k", "left").join(reached.withColumnRenamed("id", "k"), "k", "left")
        .select("lo", "hi", "least", F.coalesce("comp", "k").alias("comp"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    )
    lowest = named.groupBy("comp").agg(F.min("least").alias("component"))
    judged = keep(named.join(lowest, "comp").select("lo", "hi", "links", "component"))
    odd = F.lit(None).cast("long")
    own = source.select("id", *(F.when(F.col("sound"), F.col(c)).otherwise(odd).alias(c) for c in ("lo", "hi")))
    done = own.join(judged, ["lo", "hi"], "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    path = scratch_path(spark, "lattice-result")
    done.write.parquet(path)
    drop_path(spark, tables.root)
    done = spark.read.schema(done.schema).parquet(path)
    return done.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
