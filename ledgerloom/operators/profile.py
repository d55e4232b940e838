"""Whole-column statistics that stay exact and bounded on large data."""

from __future__ import annotations

from itertools import combinations
from math import floor, inf, nextafter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Columns with more values than this are narrowed before values are gathered.
GATHER_VALUES = 200_000
_ACCURACY = 10_000


def _q(c: str):
    return F.col(f"`{c}`")


class _Search:
    """State of the search for the value at one rank of one column."""

    def __init__(self, col: str, rank: int, rows: int):
        self.col, self.rank = col, rank
        self.lo = self.hi = None  # inclusive value bracket; None is open
        self.below = 0  # values under the bracket
        self.inside = rows  # values in the bracket
        self.value = None
        self.new = None  # bracket under test

    def rows(self):
        x = _q(self.col).cast("double")
        keep = x.isNotNull()
        if self.lo is not None:
            keep = keep & (x >= F.lit(self.lo))
        if self.hi is not None:
            keep = keep & (x <= F.lit(self.hi))
        return F.when(keep, x)

    def settle(self, under: int, at_lo: int, mid: int, at_hi: int) -> None:
        """Keep the part the rank lies in, given the counts around the new bracket.

        The ends are settled by themselves, so a value that fills most of the
        column cannot stop the search from narrowing.
        """
        lo, hi = self.new
        want = self.rank - self.below
        if want < under:
            self.hi, self.inside = nextafter(lo, -inf), under
        elif want < under + at_lo:
            self.value = lo
        elif want < under + at_lo + mid:
            self.lo, self.hi = nextafter(lo, inf), nextafter(hi, -inf)
            self.below, self.inside = self.below + under + at_lo, mid
        elif want < under + at_lo + mid + at_hi:
            self.value = hi
        else:
            passed = under + at_lo + mid + at_hi
            self.lo = nextafter(hi, inf)
            self.below, self.inside = self.below + passed, self.inside - passed


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One round: bracket each rank by approximate percentiles, then count exactly."""
    brackets: dict[tuple, list[_Search]] = {}
    for s in searches:
        brackets.setdefault((s.col, s.lo, s.hi), []).append(s)
    picks = []
    for i, group in enumerate(brackets.values()):
        bounds = []
        for s in group:
            at, slack = (s.rank - s.below) / s.inside, 3.0 / _ACCURACY
            bounds += [max(0.0, at - slack), min(1.0, at + slack)]
        picks.append(F.percentile_approx(group[0].rows(), bounds, _ACCURACY).alias(f"b{i}"))
    found = df.agg(*picks).first()
    for i, group in enumerate(brackets.values()):
        for j, s in enumerate(group):
            s.new = found[i][2 * j : 2 * j + 2]
    counts = []
    for i, s in enumerate(searches):
        x, (lo, hi) = s.rows(), s.new
        counts += [
            F.count_if(x < F.lit(lo)).alias(f"u{i}"),
            F.count_if(x == F.lit(lo)).alias(f"l{i}"),
            F.count_if((x > F.lit(lo)) & (x < F.lit(hi))).alias(f"m{i}"),
            F.count_if((x == F.lit(hi)) & F.lit(lo != hi)).alias(f"h{i}"),
        ]
    counted = df.agg(*counts).first()
    for i, s in enumerate(searches):
        s.settle(*(counted[f"{part}{i}"] for part in "ulmh"))


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], gather: int = GATHER_VALUES
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of each column, nulls left out.

    The built-in exact percentile keeps every distinct value of a column in
    one task. Here each rank is first bracketed by mergeable sketches and
    exact counts, round by round, until at most ``gather`` values remain in
    the bracket or it holds a single value; only those are then sorted. A
    round cuts the bracket by a factor of about a thousand, for all columns
    and ranks in the same two passes.
    """
    sizes = df.agg(*[F.count(_q(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
    # the bound holds for all columns and ranks together, since they meet in one row
    each = max(1, gather // max(1, 2 * len(cols) * len(probs)))
    small = [c for i, c in enumerate(cols) if 0 < sizes[i] <= each]
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if small:
        probe = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(_q(c), probe).alias(str(i)) for i, c in enumerate(small)]).first()
        result.update({c: list(row[i]) for i, c in enumerate(small)})
    searches: dict[tuple[str, int], _Search] = {}
    for i, c in enumerate(cols):
        if sizes[i] > each:
            for p in probs:
                at = p * (sizes[i] - 1)
                for rank in {floor(at), min(floor(at) + 1, sizes[i] - 1)}:
                    searches.setdefault((c, rank), _Search(c, rank, sizes[i]))
    while True:
        wide = [s for s in searches.values() if s.value is None and s.inside > each]
        if not wide:
            break
        _narrow(df, wide)
    rest = [s for s in searches.values() if s.value is None]
    if rest:
        lists = [F.sort_array(F.collect_list(s.rows())) for s in rest]
        row = df.agg(*[
            F.get(v, F.lit(s.rank - s.below)).alias(str(i)) for i, (s, v) in enumerate(zip(rest, lists))
        ]).first()
        for i, s in enumerate(rest):
            s.value = row[i]
    for i, c in enumerate(cols):
        if sizes[i] > each:
            for j, p in enumerate(probs):
                at = p * (sizes[i] - 1)
                lo = searches[c, floor(at)].value
                hi = searches[c, min(floor(at) + 1, sizes[i] - 1)].value
                result[c][j] = lo + (hi - lo) * (at - floor(at))
    return result


def medians(df: DataFrame, cols: list[str], **options) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], **options).items()}


def quartiles(df: DataFrame, cols: list[str], **options) -> dict[str, list[float | None]]:
    return exact_quantiles(df, cols, [0.25, 0.75], **options)


def moments(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, population deviation) of each column, one pass."""
    aggregates = []
    for i, c in enumerate(cols):
        aggregates += [F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"d{i}")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"m{i}"], row[f"d{i}"]) for i, c in enumerate(cols)}


_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair as (col_a, col_b, corr).

    Rows missing one of a pair do not count for that pair; a column that is
    constant there gives NULL. ``col_a`` comes after ``col_b`` in ``cols``. A
    first pass takes means and deviations; every task then multiplies its
    standardised rows as a matrix and sends one row of sums per pair.
    """
    scale = moments(df, cols)
    middle = np.array([scale[c][0] or 0.0 for c in cols])
    width = np.array([scale[c][1] or 0.0 for c in cols])
    later, earlier = np.tril_indices(len(cols), -1)

    def sums(batches):
        total = np.zeros((6, len(cols), len(cols)))
        for batch in batches:
            x = (batch.to_numpy(np.float64) - middle) / np.where(width > 0, width, 1.0)
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        picked = total[:, later, earlier]
        yield pd.DataFrame({"a": later, "b": earlier, **dict(zip(_SUMS, picked))})

    numbers = df.select(*[_q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = numbers.mapInPandas(sums, "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS))
    added = parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n = F.col("n")
    spread_x, spread_y = F.col("xx") / n - (F.col("x") / n) ** 2, F.col("yy") / n - (F.col("y") / n) ** 2
    both = F.col("xy") / n - F.col("x") / n * F.col("y") / n
    names = F.array(*[F.lit(c) for c in cols])
    # standardised numbers: what is left of a constant column is rounding
    corr = F.when((n > 0) & (spread_x > 1e-12) & (spread_y > 1e-12), both / F.sqrt(spread_x * spread_y))
    return added.withColumn("n", F.nullif(n, F.lit(0.0))).select(
        F.get(names, F.col("a")).alias("col_a"), F.get(names, F.col("b")).alias("col_b"), corr.alias("corr")
    )


def correlated_columns(df: DataFrame, cols: list[str], threshold: float = 0.8, keep=()) -> list[str]:
    """Later column of every pair correlated above the threshold, in the order of ``cols``."""
    pairs = corr_matrix(df, cols).where(F.abs("corr") > threshold).select("col_a").distinct()
    hit = {r[0] for r in pairs.collect()}
    return [c for c in cols if c in hit and c not in keep]


def graph_size(edges: DataFrame) -> DataFrame:
    """Node and edge counts of an edge list (one row per edge)."""
    ends = edges.select(F.explode(F.array("pid_1", "pid_2")).alias("node"))
    nodes = ends.distinct().select(F.lit(1).alias("nodes"), F.lit(0).alias("edges"))
    counted = nodes.union(edges.select(F.lit(0), F.lit(1)))
    return counted.agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
