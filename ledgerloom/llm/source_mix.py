"""Mixing sources to target weights by proportionate-fair scheduling.

The text of a source is cut into blocks of ``block_chars`` characters. Block j
of a source of weight w is released at slot floor(j / w) and due at slot
ceil((j + 1) / w); each slot takes the released block that is due first. In
every prefix of slots each source is then less than one block away from its
weight.

Weights are whole parts of ``parts``, so the schedule repeats after ``parts``
slots. That one period is computed on the driver, its size being a parameter, or
twice the number of sources if that is more (``SOURCES`` bounds it); the slot of
any block follows from its number. Sources that
have run out leave their slots empty, and the others keep their proportions.
Every row is kept, once.

A row's block follows from the characters before it in its source. Rows are
spread over cells of (source, hash of id); sums of cells give where each
begins, and running sums are taken inside cells, so a source that holds a third
of all rows is never in one task.

Cases: a null or empty text counts one character; a null source is a source;
null ids and ties are ordered by the hash of their text, repeated rows after
one another; an empty table gives no rows; a source without a weight in a given
table gets the least one part. Extra columns are untouched, whatever their names.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import drop_path, scratch_path

PARTS = 1024
#: Sources whose totals and schedule the driver holds and sends to every task; more raise.
SOURCES = 100_000
BLOCK_CHARS = 1 << 16


def pfair_period(parts: dict) -> list:
    """Which source takes each slot of one period: earliest deadline first among the released blocks."""
    total = sum(parts.values())
    release, due = [], []
    for order, (source, p) in enumerate(sorted(parts.items(), key=lambda kv: (kv[0] is None, str(kv[0])))):
        heapq.heappush(release, (0, order, source, p, 0))
    out = []
    for slot in range(total):
        while release and release[0][0] <= slot:
            _, order, source, p, block = heapq.heappop(release)
            heapq.heappush(due, (-(-(block + 1) * total // p), order, source, p, block))
        _, order, source, p, block = heapq.heappop(due)
        out.append(source)
        if block + 1 < p:
            heapq.heappush(release, ((block + 1) * total // p, order, source, p, block + 1))
    return out


def whole_parts(weights: dict, parts: int = PARTS) -> dict:
    """Weights as whole parts of at least one each, by largest remainder."""
    parts = max(parts, 2 * len(weights))
    total = sum(weights.values())
    spare = parts - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    left = parts - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s is None, str(s)))[:left]:
        out[s] += 1
    return out


def _schedule(spark, parts: dict) -> DataFrame:
    """(source, turn, slot, share, period): slot of the ``turn``-th block of a source within a period."""
    seen: dict = {}
    rows = []
    for slot, source in enumerate(pfair_period(parts)):
        rows.append((source, seen.setdefault(source, 0), slot, parts[source], sum(parts.values())))
        seen[source] += 1
    return spark.createDataFrame(rows, "source string, turn long, slot long, share long, period long")


def mix_sources(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_chars: int = BLOCK_CHARS, parts: int = PARTS,
) -> DataFrame:
    """(id, _hash, source, block, slot, seat) of every row; order by slot, then seat.

    ``weights`` are target weights by source; without them, the square root of
    the characters of each source. ``seat`` orders the rows of a block. More than
    ``SOURCES`` sources raise.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix")
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).cast("string").alias("source"), size.alias("chars")
    ).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    totals = rows.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("rows")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; mix groups of them")
    sums = {r["source"]: (r["chars"], r["rows"]) for r in totals}
    if not sums:
        plan = {None: 1}
    elif weights is None:
        plan = whole_parts({s: math.sqrt(c) for s, (c, _) in sums.items()}, parts)
    else:
        plan = whole_parts({s: weights.get(s, 0) for s in sums}, parts)
    # as many cells as rows in a cell, for the largest source: no window is longer than that
    cells = max(1, math.isqrt(max((n for _, n in sums.values()), default=1)))
    placed = rows.withColumn("cell", F.pmod(F.xxhash64("id", "hash"), F.lit(cells)))
    placed.groupBy("source", "cell").agg(F.sum("chars").alias("chars")).write.parquet(f"{path}/cells")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = spark.read.parquet(f"{path}/cells").select(
        F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "cell").orderBy("id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    block: Column = F.floor(F.col("place") / block_chars)
    numbered = (
        placed.withColumn("before", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .withColumn("place", F.col("start") + F.col("before"))
        .withColumn("block", block)
    )
    table = _schedule(spark, plan)
    share = F.broadcast(table.groupBy(F.col("source").alias("s2")).agg(F.max("share").alias("share")))  # one row a source
    timed = numbered.join(share, F.col("source").eqNullSafe(F.col("s2"))).withColumn("turn", F.col("block") % F.col("share"))
    slots = F.broadcast(table.select(F.col("source").alias("s3"), F.col("turn").alias("t3"), F.col("slot").alias("within"), "period"))
    done = timed.join(slots, F.col("source").eqNullSafe(F.col("s3")) & (F.col("turn") == F.col("t3"))).select(
        F.col("id").alias(id_col), F.col("hash").alias("_hash"), F.col("source").alias(source_col), "block",
        (F.floor(F.col("block") / F.col("share")) * F.col("period") + F.col("within")).alias("slot"),
        (F.col("place") % block_chars).alias("seat"),
    )
    out = scratch_path(spark, "mixed")
    done.write.parquet(out)
    drop_path(spark, path)
    return spark.read.schema(done.schema).parquet(out)
