"""Biased second-order random walks that stay in a partition until they leave its nodes.

Neighbour lists are *stations*. A node up to ``fan`` neighbours is one station;
a hub is a root, whose entries are the pieces of its list, and one station for
each piece, so no station grows with a hub. Stations lie in *parts* of bounded
size: nodes that are linked share a part, and pieces of hubs have parts of their
own. A part where many walkers are expected has copies, and a walker belongs to
the copy that its hash names.

A round brings walkers and the stations of their part together once; the task
moves all of them, in arrays, until they are done or leave the part. Stations
are stored in buckets by part and copy, so a round shuffles walkers only.
"""

from __future__ import annotations

import uuid
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.communities import place_nodes
from ledgerloom.session import drop_path, materialize, scratch_path

# Neighbour lists above this length are cut into pieces.
FAN = 2048
# Expected walkers of one copy of a part.
WALKERS_PER_TASK = 100_000
# Entries of neighbour lists in a part.
PART_ENTRIES = 500_000

_STATE = (
    "start long, walk_no int, cur long, piece int, prev long, n int, t long, "
    "cand long, cand_part long, cand_copies int, part long, copies int"
)
_PLAIN, _ROOT, _PIECE = 0, 1, 2
_ENTRY = [f"entries.{c} AS e_{c}" for c in ("id", "w", "part", "copies")]


def _both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("pid_1").alias("node"), F.col("pid_2").alias("nbr"), "occurrence_ct")
    b = edges.select("pid_2", "pid_1", "occurrence_ct")
    return a.union(b).select(F.col("node").cast("long"), F.col("nbr").cast("long"), F.col("occurrence_ct").cast("double").alias("w"))


def _piece_of(node: int, pieces: int) -> int:
    """The piece of a hub's list that would hold ``node``; as in ``_Stations``."""
    return zlib.crc32(str(node).encode()) % pieces


class _Stations:
    """Table of stations with their parts and copies.

    Columns: part, copy, copies; node, piece (-1: a node or root), pieces of the
    node, kind; part and copies of the root (of a piece) or of its own; entries
    as four lists: id, w, and the part and copies where the entry leads.
    """

    def __init__(self, edges: DataFrame, fan: int, num_walks: int, walkers_per_task: int, part_entries: int):
        spark = edges.sparkSession
        links = _both_ways(edges)
        stats = materialize(links.groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("weight")), "degrees")
        total, nodes, entries = stats.agg(F.sum("weight"), F.count("*"), F.sum("degree")).first()
        self.walkers = nodes * num_walks
        hub = F.col("degree") > fan
        pieces = F.when(hub, F.ceil(F.sqrt("degree"))).otherwise(0).cast("int")
        stats = stats.withColumn("pieces", pieces)
        self.cores = spark.sparkContext.defaultParallelism
        self.room = max(1, min(walkers_per_task, ceil(self.walkers / self.cores)))
        if (entries or 0) <= part_entries and not stats.where(hub).limit(1).count():
            self._one_part(links, stats)
        else:
            self._many_parts(links, stats, hub, total or 1.0, num_walks, part_entries, (entries or 0) <= part_entries)

    def _one_part(self, links: DataFrame, stats: DataFrame) -> None:
        """A graph that fits one task and has no hub: every copy holds all of it."""
        copies = max(1, ceil(self.walkers / self.room))
        here, every = F.lit(0).cast("long"), F.lit(copies)
        self.starts = stats.select("node", here.alias("part"), every.alias("copies"))
        entry = F.struct(F.col("nbr").alias("id"), "w", here.alias("part"), every.alias("copies"))
        leaves = links.groupBy("node").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        stations = leaves.select(
            here.alias("part"), F.explode(F.sequence(F.lit(0), every - 1)).alias("copy"), every.alias("copies"), "node", F.lit(-1).alias("piece"),
            F.lit(0).alias("pieces"), F.lit(_PLAIN).alias("kind"), here.alias("home"), every.alias("home_copies"), *map(F.expr, _ENTRY),
        )
        self.name = self.path = None
        self.table = materialize(stations, "stations")

    def _many_parts(self, links: DataFrame, stats: DataFrame, hub, total: float, num_walks: int, part_entries: int, whole: bool) -> None:
        spark = links.sparkSession
        if whole:
            placed = stats.withColumn("part", F.lit(0).cast("long"))
        else:
            plain = stats.where(~hub)
            hubs = stats.where(hub).select("node")
            among = links.join(hubs, "node", "left_anti").join(hubs.withColumnRenamed("node", "nbr"), "nbr", "left_anti")
            found = place_nodes(materialize(among, "among"), plain.select("node", F.col("degree").cast("double").alias("load")), part_entries)
            of_hubs = max(1, ceil((stats.where(hub).agg(F.sum("degree")).first()[0] or 0) / part_entries))
            # Parts of hubs and their pieces are below zero.
            own = -1 - F.pmod(F.xxhash64("node"), F.lit(of_hubs))
            placed = stats.join(found, "node", "left").withColumn("part", F.coalesce("part", own))
        nodes = materialize(placed.select("node", "part", "pieces", "weight"), "placed")
        in_piece = F.when(F.col("pieces") > 0, F.crc32(F.col("nbr").cast("string").cast("binary")) % F.col("pieces")).otherwise(-1).cast("int")
        piece_part = F.lit(0).cast("long") if whole else -1 - F.pmod(F.xxhash64("node", "piece"), F.lit(of_hubs))
        lists = (
            links.join(nodes.select("node", "pieces", F.col("part").alias("home")), "node")
            .withColumn("piece", in_piece)
            .withColumn("part", F.when(F.col("piece") < 0, F.col("home")).otherwise(piece_part))
        )
        lists = lists.select("node", "piece", "pieces", "part", "home", "nbr", "w")
        # A part's copies follow from the walkers that are there at the start, or in the long run.
        share = F.col("weight") / F.lit(total) * self.walkers
        visits = nodes.select("part", "weight", F.lit(num_walks).alias("starts")).union(
            lists.where("piece >= 0").groupBy("part").agg(F.sum("w").alias("weight")).select("part", "weight", F.lit(0))
        )
        copies = F.ceil(F.greatest(F.sum(share), F.sum("starts")) / self.room).cast("int")
        at_part = materialize(visits.groupBy("part").agg(F.greatest(copies, F.lit(1)).alias("copies")), "copies")
        self.starts = nodes.join(at_part, "part").select("node", "part", "copies")
        at = self.starts.select(F.col("node").alias("nbr"), F.col("part").alias("to_part"), F.col("copies").alias("to_copies"))
        entry = F.struct(F.col("nbr").alias("id"), "w", F.col("to_part").alias("part"), F.col("to_copies").alias("copies"))
        leaves = (
            lists.join(at, "nbr").groupBy("node", "piece")
            .agg(*(F.first(c).alias(c) for c in ("pieces", "part", "home")), F.sort_array(F.collect_list(entry)).alias("entries"))
        )
        leaves = materialize(leaves, "neighbours")
        weight = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["w"])
        parts = leaves.where("piece >= 0").join(at_part, "part")
        parted = F.struct(F.col("piece").cast("long").alias("id"), weight.alias("w"), "part", "copies")
        roots = parts.groupBy("node").agg(F.first("pieces").alias("pieces"), F.first("home").alias("part"), F.sort_array(F.collect_list(parted)).alias("entries"))
        kind = F.when(F.col("piece") < 0, _PLAIN).otherwise(_PIECE)
        stations = leaves.select("node", "piece", "pieces", kind.alias("kind"), "part", "home", "entries").unionByName(
            roots.select("node", F.lit(-1).alias("piece"), "pieces", F.lit(_ROOT).alias("kind"), "part", F.col("part").alias("home"), "entries")
        )
        homes = at_part.select(F.col("part").alias("home"), F.col("copies").alias("home_copies"))
        stations = stations.join(at_part, "part").join(homes, "home").select(
            "part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "copies", "node", "piece", "pieces", "kind", "home", "home_copies", *map(F.expr, _ENTRY)
        )
        groups = at_part.agg(F.sum("copies")).first()[0] or 1
        self.name = self.path = None
        if whole:
            self.table = materialize(stations, "stations")
        else:
            self.path, self.name = scratch_path(spark, "stations"), f"ledgerloom_stations_{uuid.uuid4().hex}"
            buckets = int(min(max(groups, self.cores), 20_000))
            stations.repartition(buckets, "part", "copy").write.bucketBy(buckets, "part", "copy").sortBy("part", "copy").option(
                "path", self.path
            ).saveAsTable(self.name)
            self.table = spark.table(self.name)

    def drop(self) -> None:
        if self.name:
            spark = self.table.sparkSession
            spark.sql(f"DROP TABLE {self.name}")
            drop_path(spark, self.path)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _numbers(column, kind, missing=0) -> np.ndarray:
    """Values of an Arrow column, nulls as ``missing``."""
    filled = column.fill_null(missing) if column.null_count else column
    return filled.to_numpy().astype(kind)


class _Lists:
    """The stations of one part as flat arrays."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((_numbers(table["piece"], np.int64), _numbers(table["node"], np.int64)))
        table = table.take(pa.array(order)).combine_chunks()
        node, self.piece, self.kind, self.cut, self.home, self.home_copies = (
            _numbers(table[c], np.int64) for c in ("node", "piece", "kind", "pieces", "home", "home_copies")
        )
        self.nodes, rank = np.unique(node, return_inverse=True)
        self.pieces = int(self.piece.max()) + 3
        self.key = rank * self.pieces + self.piece + 1
        self.part = int(table["part"][0].as_py())
        column = table["e_id"].combine_chunks()
        size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.id, self.to_part, self.to_copies = (
            table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("e_id", "e_part", "e_copies")
        )
        weight = table["e_w"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # running weights of each list start anew, so that long tables lose no digits
        running = np.cumsum(weight)
        before = np.concatenate(([0.0], running))[self.begin]
        self.owner = np.repeat(np.arange(len(size)), size)
        self.upto = running - before[self.owner]
        self.total = self.upto[self.end - 1]
        # share of the list's weight plus the list's number: ascending over all entries
        self.scale = self.owner + np.minimum(self.upto / self.total[self.owner], 1.0)
        self.ids = np.unique(self.id)
        self.known = np.sort(self.owner * (len(self.ids) + 1) + np.searchsorted(self.ids, self.id))

    def find(self, node: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Place of the station of a node and piece, or -1."""
        rank = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
        key = rank * self.pieces + np.minimum(piece + 1, self.pieces - 1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.nodes[rank] == node) & (self.piece[at] == piece) & (self.key[at] == key), at, -1)

    def draw(self, station: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Entry that the point ``u`` of the weights of each station falls on."""
        at = np.searchsorted(self.scale, station + u, side="right")
        return np.clip(at, self.begin[station], self.end[station] - 1)

    def has(self, station: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether the list of each station has ``node``."""
        rank = np.minimum(np.searchsorted(self.ids, node), len(self.ids) - 1)
        key = station * (len(self.ids) + 1) + rank
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        return (self.ids[rank] == node) & (self.known[at] == key)


class _Walkers:
    """The walkers of one task, moved together."""

    def __init__(self, table: pa.Table, lists: _Lists, length: int, p: float, q: float, seed: int):
        self.lists, self.length = lists, length
        peak = max(1 / p, 1.0, 1 / q)
        self.back, self.near, self.far = 1 / p / peak, 1 / peak, 1 / q / peak
        get = lambda c: _numbers(table[c], np.int64)
        self.start, self.walk_no, self.cur, self.piece, self.prev, self.n, self.t, self.cand, self.cand_part, self.cand_copies = (
            get(c) for c in ("start", "walk_no", "cur", "piece", "prev", "n", "t", "cand", "cand_part", "cand_copies")
        )
        valid = lambda c: ~np.asarray(table[c].is_null())
        self.has_prev, self.asks = valid("prev"), valid("cand")
        with np.errstate(over="ignore"):
            mine = _spread_bits(self.start.view(np.uint64) + _spread_bits(self.walk_no.view(np.uint64) + np.uint64(seed % 2**64) * np.uint64(0x9E3779B97F4A7C15)))
        self.mine = mine
        self.part, self.copies = np.full(len(mine), lists.part), get("copies")
        self.moves: list[tuple[np.ndarray, np.ndarray]] = []

    def u(self, who: np.ndarray, what: int) -> np.ndarray:
        """Uniform draws that depend only on the seed, the walk and the attempt."""
        with np.errstate(over="ignore"):
            bits = _spread_bits(self.mine[who] + self.t[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(what))
        return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def _arrive(self, who: np.ndarray, node: np.ndarray) -> None:
        self.prev[who], self.has_prev[who] = self.cur[who], True
        self.cur[who], self.piece[who] = node, -1
        self.n[who] += 1
        self.t[who] += 1
        self.moves.append((who, node))

    def _decide(self, who: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.u(who, 2) < np.where(near, self.near, self.far)

    def _answer(self, who: np.ndarray) -> np.ndarray:
        """Walkers that came to ask whether their last node is a neighbour of the candidate; returns those that stay here."""
        lists = self.lists
        at = lists.find(self.cand[who], self.piece[who])
        known = np.ones(len(who), bool)
        for i in np.flatnonzero((at >= 0) & (lists.kind[at] == _ROOT)):
            # the piece that would hold the last node: absent, here, or elsewhere
            walker, piece = who[i], _piece_of(int(self.prev[who[i]]), int(lists.cut[at[i]]))
            entries = slice(lists.begin[at[i]], lists.end[at[i]])
            hit = np.flatnonzero(lists.id[entries] == piece)
            at[i] = -1
            if len(hit):
                e = entries.start + hit[0]
                if lists.to_part[e] == lists.part:
                    at[i] = lists.find(self.cand[who[i : i + 1]], np.array([piece]))[0]
                else:
                    known[i] = False
                    self.piece[walker], self.part[walker], self.copies[walker] = piece, lists.to_part[e], lists.to_copies[e]
        near = (at >= 0) & lists.has(np.maximum(at, 0), self.prev[who])
        who, near = who[known], near[known]
        yes = self._decide(who, near)
        taken, left = who[yes], who[~yes]
        self.part[taken], self.copies[taken] = self.cand_part[taken], self.cand_copies[taken]
        self._arrive(taken, self.cand[taken])
        self.t[left] += 1
        self.piece[left] = -1  # back to where the candidate was drawn
        self.part[left], self.copies[left] = self.home_part[left], self.home_copies[left]
        self.asks[who] = False
        return who[self.part[who] == lists.part]

    def run(self, home_part: np.ndarray, home_copies: np.ndarray) -> None:
        """Move all walkers until they are done or leave the part."""
        lists = self.lists
        self.home_part, self.home_copies = home_part, home_copies
        going = np.arange(len(self.start))
        asking = going[self.asks]
        going = np.concatenate((going[~self.asks], self._answer(asking) if len(asking) else asking))
        station = np.empty(len(self.start), np.int64)
        while len(going):
            going = going[self.n[going] < self.length]
            if not len(going):
                break
            station[going] = lists.find(self.cur[going], self.piece[going])
            at = station[going]
            root = lists.kind[at] == _ROOT
            entry = lists.draw(at, np.where(root, self.u(going, 0), self.u(going, 1)))
            to, part, copies = lists.id[entry], lists.to_part[entry], lists.to_copies[entry]
            # a root leads to one of its pieces
            who = going[root]
            self.piece[who] = to[root]
            self.part[who], self.copies[who] = part[root], copies[root]
            # others draw a neighbour and take it with the chance of its distance
            own = ~root
            who, to, part, copies, at = going[own], to[own], part[own], copies[own], at[own]
            back = self.has_prev[who] & (to == self.prev[who])
            u = self.u(who, 2)
            sure = ~self.has_prev[who] | (u < np.where(back, self.back, min(self.near, self.far)))
            never = ~sure & (back | (u >= max(self.near, self.far)))
            open_ = ~sure & ~never
            if open_.any():
                # the last node is a neighbour of the candidate if either list, where it is here, says so
                i = np.flatnonzero(open_)
                place = lists.find(to[i], np.full(len(i), -1))
                other = lists.find(self.prev[who[i]], np.full(len(i), -1))
                by_to = (place >= 0) & (lists.kind[place] == _PLAIN)
                by_prev = ~by_to & (other >= 0) & (lists.kind[other] == _PLAIN)
                near = np.where(by_to, lists.has(np.maximum(place, 0), self.prev[who[i]]), lists.has(np.maximum(other, 0), to[i]))
                answered = by_to | by_prev
                yes = u[i] < np.where(near, self.near, self.far)
                sure[i[answered & yes]] = True
                never[i[answered & ~yes]] = True
                asks = i[~answered]
                w = who[asks]
                self.asks[w], self.piece[w] = True, -1
                self.cand[w], self.cand_part[w], self.cand_copies[w] = to[asks], part[asks], copies[asks]
                self.home_part[w], self.home_copies[w] = lists.home[at[asks]], lists.home_copies[at[asks]]
                self.part[w], self.copies[w] = part[asks], copies[asks]
            w = who[sure]
            self.part[w], self.copies[w] = part[sure], copies[sure]
            self._arrive(w, to[sure])
            w = who[never]
            self.t[w] += 1
            self.piece[w] = -1
            self.part[w], self.copies[w] = lists.home[at[never]], lists.home_copies[at[never]]
            stays = (self.part[going] == lists.part) & ~self.asks[going]
            waiting = going[(self.part[going] == lists.part) & self.asks[going]]
            going = going[stays]
            if len(waiting):
                going = np.concatenate((going, self._answer(waiting)))

    def table(self) -> pa.Table:
        if self.moves:
            who = np.concatenate([w for w, _ in self.moves])
            node = np.concatenate([x for _, x in self.moves])
        else:
            who = node = np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(self.start))))).astype(np.int32)
        i32 = lambda x: pa.array(x.astype(np.int32))
        maybe = lambda x, ok: pa.array(x, mask=~ok)
        columns = {
            "start": pa.array(self.start), "walk_no": i32(self.walk_no), "cur": pa.array(self.cur), "piece": i32(self.piece),
            "prev": maybe(self.prev, self.has_prev), "n": i32(self.n), "t": pa.array(self.t), "cand": maybe(self.cand, self.asks),
            "cand_part": pa.array(self.cand_part), "cand_copies": i32(self.cand_copies), "part": pa.array(self.part), "copies": i32(self.copies),
            "home_part": pa.array(self.home_part), "home_copies": i32(self.home_copies),
            "hops": pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[order])),
        }
        return pa.table(columns)


_MOVED = f"{_STATE}, home_part long, home_copies int, hops array<long>"


def _mover(length: int, p: float, q: float, seed: int):
    def move(walkers: pa.Table, stations: pa.Table) -> pa.Table:
        if not walkers.num_rows:  # a part nobody is in
            empty = np.zeros(0, np.int64)
            columns = {c: pa.array(empty, pa.int64()) for c in ("start", "cur", "prev", "t", "cand", "cand_part", "part", "home_part")}
            columns |= {c: pa.array(empty, pa.int32()) for c in ("walk_no", "piece", "n", "cand_copies", "copies", "home_copies")}
            columns["hops"] = pa.array([], pa.list_(pa.int64()))
            return pa.table({part.split()[0]: columns[part.split()[0]] for part in _MOVED.split(", ")})
        group = _Walkers(walkers, _Lists(stations), length, p, q, seed)
        group.run(_numbers(walkers["home_part"], np.int64), _numbers(walkers["home_copies"], np.int64))
        made = group.table()
        return made.select([part.split()[0] for part in _MOVED.split(", ")])

    return move


def random_walks(
    edges: DataFrame,
    num_walks: int = 10,
    length: int = 50,
    p: float = 2.0,
    q: float = 1.0,
    seed: int = 1,
    fan: int = FAN,
    hot_walkers: int = WALKERS_PER_TASK,
    part_entries: int = PART_ENTRIES,
) -> DataFrame:
    """(start, walk_no, path): ``num_walks`` walks of ``length`` nodes from every node.

    The next node is drawn by edge weight, times ``1/p`` when it is the
    previous node, 1 when it is a neighbour of the previous node, and ``1/q``
    otherwise. A draw by weight is accepted with the matching chance and
    repeated when rejected, which gives exactly that distribution without
    listing the candidates of a step. Whether two nodes are neighbours is read
    from either list in the part; where neither is, the walker goes to the
    candidate to ask, and stays there if the draw is accepted. Draws are hashes
    of (seed, walk, attempt), so the walks do not depend on parts, copies or
    partitions, and a lost task repeats them.

    Node ids are whole numbers. State is written once a round.
    """
    edges = materialize(edges.select("pid_1", "pid_2", "occurrence_ct"), "edges")
    stations = _Stations(edges, fan, num_walks, hot_walkers, part_entries)
    move = _mover(length, p, q, seed)
    no = F.lit(None).cast("long")
    state = stations.starts.select(
        F.col("node").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(num_walks))).alias("walk_no"), F.col("node").alias("cur"),
        F.lit(-1).alias("piece"), no.alias("prev"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("t"),
        no.alias("cand"), F.lit(0).cast("long").alias("cand_part"), F.lit(0).alias("cand_copies"), "part", "copies",
        F.lit(0).cast("long").alias("home_part"), F.lit(0).alias("home_copies"),
    )
    blocks: list[DataFrame] = []
    copy = F.pmod(F.xxhash64("start", "walk_no"), F.col("copies")).cast("int")
    while True:
        here = state.withColumn("copy", copy)
        table = stations.table
        if blocks:  # only parts that somebody is in
            table = table.join(here.select("part", "copy").distinct(), ["part", "copy"], "left_semi")
        done = here.groupBy("part", "copy").cogroup(table.groupBy("part", "copy")).applyInArrow(move, _MOVED)
        done = materialize(done, "walk-round")
        blocks.append(done.select("start", "walk_no", F.lit(len(blocks)).alias("block"), "hops"))
        state = done.where(F.col("n") < length).drop("hops")
        if state.isEmpty():
            break
    stations.drop()
    if len(blocks) == 1:
        return blocks[0].select("start", "walk_no", F.concat(F.array("start"), "hops").alias("path"))
    parts = blocks[0]
    for block in blocks[1:]:
        parts = parts.union(block)
    ordered = F.sort_array(F.collect_list(F.struct("block", "hops")))
    hops = parts.where(F.size("hops") > 0).groupBy("start", "walk_no").agg(F.flatten(F.transform(ordered, lambda b: b["hops"])).alias("hops"))
    return hops.select("start", "walk_no", F.concat(F.array("start"), "hops").alias("path"))
