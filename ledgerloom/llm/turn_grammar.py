"""Structure repair of conversations by weighted CYK parsing of intervals of turns.

A conversation should read ``(s? (u a)+)?`` in the initials of its roles: at
most one system turn, then users and assistants by turns. Turns are kept (cost
0), given the role user or assistant (3), deleted (4) or inserted without text
(3); blank and repeated turns must be deleted, and a truncated one that stays
costs 3 more.

1. Facts of turns (blank, repeated, truncated) come from DataFrame work on hashes
   of texts; the texts themselves are not moved. Turns that agree in all columns
   are one row with a count. Rows are sorted by range, so a long conversation
   lies in many tasks.
2. A span of turns has a cell for each nonterminal of a grammar in Chomsky
   normal form: nothing, or a legal string by its first and last role. A cell
   holds the least (cost, audit), the audit being the initials of the edits.
   Spans are combined bottom-up by length over all their splits, and closed
   under insertion at either side. Of two audits of equal cost for the same
   turns neither begins the other, so the least of a span is made of least parts.
3. The nonterminals describe every factor of a legal string, so the cell of a
   span serves as a turn of a longer one: eight turns are parsed in a chart, then
   eight such spans, and so on, first inside a task, then over pieces of long
   conversations. Charts stay small whatever the length.
4. The audit of a conversation is replayed over its turns, streamed in order.

Cases: a null id is a conversation; null roles and texts are one space; null
turns come first; turns with one number are ordered by role, then by the SHA-256
of the text; an empty role has no initial; other columns are ignored, whatever
their names; a conversation without turns costs 0 and has an empty audit; an
empty table gives no rows. The audit has a letter a turn and so grows with its
conversation, and one task streams the turns of a conversation when its audit is
replayed, as the hash of a transcript has to be taken in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.near_dedup import _Tables
from ledgerloom.session import drop_path, scratch_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Nonterminals: nothing, or the first and the last role of a legal string.
KINDS = ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
SPACE = r"\x20\x09-\x0D"
#: Spans of a chart.
WIDTH = 8
# Turns of a piece, and pieces of a conversation that one task combines.
PIECE, FAN = 4096, 64

_AT = {kind: i for i, kind in enumerate(KINDS)}
#: whole -> left right
RULES = [(i, 0, i) for i in range(len(KINDS))] + [(i, i, 0) for i in range(1, len(KINDS))] + [
    (_AT[y[0] + z[1]], _AT[y], _AT[z]) for y in KINDS[1:] for z in KINDS[4:] if y[1] + z[0] in LEGAL
]
_INSERTED = [(INSERT, "I") if kind in ("uu", "aa") else None for kind in KINDS]
_FACTS = "blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, turns long, low long, high long"


def _combine(best: list, left: list, right: list) -> bool:
    """Put into ``best`` what ``left`` and ``right`` make, where it is less."""
    better = False
    for whole, y, z in RULES:
        a, b = left[y], right[z]
        if a is not None and b is not None:
            cost, old = a[0] + b[0], best[whole]
            if old is None or cost <= old[0]:
                new = (cost, a[1] + b[1])
                if old is None or new < old:
                    best[whole] = new
                    better = True
    return better


def closed(cell: list) -> list:
    """The cell with insertions at either side."""
    while _combine(cell, list(cell), _INSERTED) | _combine(cell, _INSERTED, list(cell)):
        pass
    return cell


def turn_cell(symbol: str) -> list:
    """Cell of one turn: ``d`` must go; else the initial (``x``: another), upper case if truncated."""
    cell = [(DELETE, "D")] + [None] * (len(KINDS) - 1)
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        for kind in ("ss", "uu", "aa"):
            if kind[0] == symbol.lower():
                cell[_AT[kind]] = (KEEP + more, "K")
            elif kind != "ss":
                cell[_AT[kind]] = (REROLE + more, "R")
    return closed(cell)


def chart(cells: list[list]) -> list:
    """Cell of the whole of some neighbouring spans, by all splits of all intervals."""
    n = len(cells)
    spans = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = [None] * len(KINDS)
            for k in range(i + 1, i + length):
                _combine(best, spans[i, k], spans[k, i + length])
            spans[i, i + length] = closed(best)
    return spans[0, n]


def parse(cells: list[list]) -> list:
    """Cell of any number of neighbouring spans."""
    while len(cells) > 1:
        cells = [chart(cells[i : i + WIDTH]) for i in range(0, len(cells), WIDTH)]
    return cells[0]


def cheapest(cell: list) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(x for x in (cell[_AT[k]] for k in ("", "ua", "sa")) if x is not None)


class Parser:
    """Charts of turns, remembered by their symbols."""

    def __init__(self, limit: int = 50_000):
        self.known: dict[str, list] = {}
        self.limit = limit

    def __call__(self, symbols: list[tuple[str, int]]) -> list:
        """Cell of turns given as (symbol, number of repeats that must go)."""
        cells, text = [], []
        for symbol, repeats in symbols:
            text.append(symbol)
            if repeats <= WIDTH:
                text.append("d" * repeats)
            else:
                cells += self._blocks("".join(text))
                text = []
                cells.append(closed([(DELETE * repeats, "D" * repeats)] + [None] * (len(KINDS) - 1)))
        return parse(cells + self._blocks("".join(text)))

    def _blocks(self, text: str) -> list[list]:
        out = []
        for i in range(0, len(text), WIDTH):
            block = text[i : i + WIDTH]
            cell = self.known.get(block)
            if cell is None:
                if len(self.known) >= self.limit:
                    self.known.clear()
                cell = self.known[block] = chart([turn_cell(s) for s in block])
            out.append(cell)
        return out


class _Piece:
    """Neighbouring turns of one conversation: counts, ends, and the cell."""

    def __init__(self, conv, at, counts, first, last, turns, low, high, cell):
        self.conv, self.at, self.counts, self.first, self.last = conv, at, counts, first, last
        self.turns, self.low, self.high, self.cell = turns, low, high, cell


def _joined(pieces: list[_Piece]) -> _Piece:
    counts = [sum(x) for x in zip(*(p.counts for p in pieces))]
    turns, low, high = 0, None, None
    for p in pieces:
        turns += p.turns - (high is not None and p.low == high)
        low = p.low if low is None else low
        high = p.high if p.high is not None else high
    counts[3] += sum((a.last or "") + (b.first or "") not in LEGAL for a, b in zip(pieces, pieces[1:]))
    return _Piece(pieces[0].conv, pieces[0].at, counts, pieces[0].first, pieces[-1].last, turns, low, high, parse([p.cell for p in pieces]))


_PIECE = f"conv string, at long, {_FACTS}, costs array<long>, audits array<string>"


def _rows_of(pieces: list[_Piece]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.string())]
    rows = [
        (p.conv, p.at, *p.counts, p.first, p.last, p.turns, p.low, p.high, [x and x[0] for x in p.cell], [x and x[1] for x in p.cell])
        for p in pieces
    ]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    names = [part.split()[0] for part in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _parse_turns(batches):
    """Pieces of sorted turns: neighbouring rows of one conversation, up to a bound."""
    parser = Parser()
    held: list[tuple] = []

    def piece() -> _Piece:
        counts, symbols, turns, last_turn, last = [0, 0, 0, 0], [], 0, None, None
        for _, _, turn, role, fault, n in held:
            initial = role[:1]
            if last is not None and last + initial not in LEGAL:
                counts[3] += 1
            counts[3] += n - 1
            last = initial
            kind = initial if initial in ("s", "u", "a") else "x"
            if fault < 3:
                counts[fault] += 1
            # repeats of a blank turn are blank, others are duplicates
            counts[0 if fault == 0 else 1] += n - 1
            symbols.append(("d" if fault < 2 else kind.upper() if fault == 2 else kind, n - 1))
            if turn is not None and turn != last_turn:
                turns, last_turn = turns + 1, turn
        known = [r[2] for r in held if r[2] is not None]
        low, high = (known[0], known[-1]) if known else (None, None)
        return _Piece(held[0][0], held[0][1], counts, held[0][3][:1], last, turns, low, high, parser(symbols))

    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "turn", "role", "fault", "n"))):
            if held and (held[0][0] != row[0] or len(held) >= PIECE):
                done.append(piece())
                held = []
            held.append(row)
        if done:
            yield _rows_of(done)
    if held:
        yield _rows_of([piece()])


def _merge(batches):
    """Join up to FAN neighbouring pieces of one conversation; rows arrive sorted."""
    held: list[_Piece] = []
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            cell = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
            counts = [row[c] for c in ("blank", "duplicate", "truncated", "illegal")]
            p = _Piece(row["conv"], row["at"], counts, row["first_role"], row["last_role"], row["turns"], row["low"], row["high"], cell)
            if held and (held[0].conv != p.conv or len(held) >= FAN):
                done.append(_joined(held))
                held = []
            held.append(p)
        if done:
            yield _rows_of(done)
    if held:
        yield _rows_of([_joined(held)])


def _verdicts(batches):
    """Cost and audit of whole conversations."""
    for batch in _merge(batches):
        best = [
            cheapest([None if c is None else (c, a) for c, a in zip(costs, audits)])
            for costs, audits in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist())
        ]
        low, high, turns = (batch.column(c).to_pylist() for c in ("low", "high", "turns"))
        gaps = [0 if a is None else b - a + 1 - n for a, b, n in zip(low, high, turns)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv"), pa.array(gaps, pa.int64()),
                *(batch.column(c) for c in ("blank", "duplicate", "truncated", "illegal")),
                pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string()),
            ],
            ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
        )


_VERDICT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def normal_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv (as text), turn, role, text: the columns that count, nulls of role and text as one space."""
    return turns.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def audit_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    spark = turns.sparkSession
    tables = _Tables(spark)
    keep = tables.keep
    rows = normal_turns(turns, conv_col, turn_col, role_col, text_col)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    own = F.when(blank, 0).when(whole, 3).otherwise(2)
    facts = rows.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.min(own).alias("own"))
    facts = keep(facts)
    firsts = facts.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    f = firsts.select(F.col("conv").alias("fc"), F.col("role").alias("fr"), F.col("digest").alias("fd"), "first")
    same = facts["conv"].eqNullSafe(f["fc"]) & (facts["role"] == f["fr"]) & (facts["digest"] == f["fd"])
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    judged = facts.join(f, same).select(
        "conv", "turn", "role", "digest", F.when(F.col("own") == 0, 0).when(again, 1).otherwise(F.col("own")).alias("fault"), "n"
    )
    order = ["conv", "turn", "role", "digest"]
    ordered = keep(
        judged.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", F.monotonically_increasing_id().alias("at"), "turn", "role", "fault", "n")
    )
    pieces = keep(ordered.mapInArrow(_parse_turns, _PIECE))
    while True:
        many = pieces.groupBy("conv").count().where(F.col("count") > FAN)
        many = keep(many.select(F.col("conv").alias("mc"), "count"))
        total = many.agg(F.sum("count")).first()[0]
        if not total:
            break
        is_many = pieces["conv"].eqNullSafe(many["mc"])
        parts = max(1, total // (FAN * FAN))
        merged = (
            pieces.join(many, is_many, "left_semi").repartitionByRange(parts, "conv", "at").sortWithinPartitions("conv", "at")
            .mapInArrow(_merge, _PIECE)
        )
        pieces = keep(pieces.join(many, is_many, "left_anti").union(merged))
    verdicts = pieces.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_verdicts, _VERDICT)
    path = scratch_path(spark, "turn-verdicts")
    kind = turns.schema[conv_col].dataType
    done = verdicts.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)
    done.write.parquet(path)
    drop_path(spark, tables.root)
    return spark.read.schema(done.schema).parquet(path)


class Replay:
    """Roles that an audit gives the turns of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.before = audit, 0, ""

    def _role(self) -> str:
        return "u" if self.before != "u" else "a"

    def inserted(self):
        """Roles of turns inserted here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.before = self._role()
            yield ROLES[self.before]

    def turn(self, role: str) -> str | None:
        """New role of the next turn; None if it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        self.before = role[0] if edit == "K" else self._role()
        return role if edit == "K" else ROLES[self.before]


def _sorted_with_audits(turns: DataFrame, verdicts: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns of a conversation in order behind a row with its audit, in one task."""
    rows = normal_turns(turns, conv, turn, role, text).withColumn("kind", F.lit(1))
    heads = verdicts.select(
        F.col(conv).cast("string").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(b"").alias("digest"), F.lit(0).alias("kind"),
    )
    both = rows.unionByName(heads)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text")


def _replayed(batches):
    """For every conversation its id at the start, then (role, text) of its repaired turns, then the end: (event, a, b)."""
    replay = None
    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
            if kind == 0:
                if replay is not None:
                    yield "end", None, None
                replay = Replay(text)
                yield "start", conv, None
                yield from (("turn", r, "") for r in replay.inserted())
                continue
            new = replay.turn(role)
            if new is not None:
                yield "turn", new, text
            yield from (("turn", r, "") for r in replay.inserted())
        yield "batch", None, None
    if replay is not None:
        yield "end", None, None


def _emit_turns(batches):
    held, conv, place = [], None, 0

    def out():
        columns = list(zip(*held)) if held else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["conv", "place", "role", "text"]
        )

    for event, a, b in _replayed(batches):
        if event == "start":
            conv, place = a, 0
        elif event == "turn":
            held.append((conv, place, a, b))
            place += 1
        elif event == "batch":
            yield out()
            held = []
    yield out()


def _emit_digests(batches):
    held, conv, digest, place = [], None, hashlib.sha256(), 0

    def out():
        columns = list(zip(*held)) if held else [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["conv", "digest"])

    for event, a, b in _replayed(batches):
        if event == "start":
            conv, digest, place = a, hashlib.sha256(), 0
        elif event == "turn":
            digest.update(f"{chr(10) if place else ''}{a}:{b}".encode())
            place += 1
        elif event == "end":
            held.append((conv, digest.hexdigest()))
        elif held:
            yield out()
            held = []
    yield out()


def repaired_turns(
    turns: DataFrame, verdicts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Turns of the repaired conversations: id, place (from 0), role, text."""
    kind = turns.schema[conv_col].dataType
    made = _sorted_with_audits(turns, verdicts, conv_col, turn_col, role_col, text_col).mapInArrow(
        _emit_turns, "conv string, place long, role string, text string"
    )
    return made.select(F.col("conv").cast(kind).alias(conv_col), "place", F.col("role").alias(role_col), F.col("text").alias(text_col))


def transcript_digests(
    turns: DataFrame, verdicts: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """SHA-256 of each repaired transcript: lines ``role:text``."""
    kind = turns.schema[conv_col].dataType
    made = _sorted_with_audits(turns, verdicts, conv_col, turn_col, role_col, text_col).mapInArrow(_emit_digests, "conv string, digest string")
    return made.select(F.col("conv").cast(kind).alias(conv_col), F.col("digest").alias("repaired_sha256"))
