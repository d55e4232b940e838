"""Column expressions: dates, ids, tags, categories, ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Payment states, in pivot order.
PAYMENT_STATES = ["early", "late", "ontime", "NA"]


def parse_event_time(c: Column) -> Column:
    """Event time from text that ends in a 4-character zone suffix such as `` UTC``."""
    return F.to_timestamp_ntz(c.substr(F.lit(1), F.length(c) - 4))


def parse_us_date(c: Column, strict: bool = True) -> Column:
    """Month/day/year text to a date; empty text is NULL, bad text raises when strict."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.to_date(text, "M/d/yyyy") if strict else F.try_to_date(text, "M/d/yyyy")


# Tried in this order by parse_any_date when the text is no ISO date.
DATE_FORMATS = ("M/d/yyyy", "d-MMM-yyyy", "yyyy/M/d")


def parse_any_date(c: Column, formats=DATE_FORMATS) -> Column:
    """ISO date, else the first format that reads the text; NULL when none does."""
    return F.coalesce(c.try_cast("date"), *[F.try_to_date(F.trim(c), f) for f in formats])


def payment_delay(due: Column, paid: Column) -> Column:
    """Days from payment to due date: positive is early, negative is late."""
    return F.datediff(due, paid)


def payment_status(delay: Column) -> Column:
    return (
        F.when(delay == 0, "ontime").when(delay < 0, "late").when(delay > 0, "early").otherwise("NA")
    )


def add_days(d: Column, days: Column) -> Column:
    """Date plus fractional days, cut to the day it falls on."""
    return F.date_add(d, F.floor(days).cast("int"))


def week_of(d: Column) -> Column:
    """ISO week number without the year."""
    return F.weekofyear(d).cast("bigint")


def iso_year(d: Column) -> Column:
    """Year the ISO week of ``d`` belongs to: that of its Thursday."""
    return F.year(F.date_add(d, F.lit(3) - F.weekday(d))).cast("bigint")


def canonical_edge(a: Column, b: Column) -> tuple[Column, Column]:
    """Larger id first, so that both directions give one edge."""
    return F.greatest(a, b), F.least(a, b)


def ne_or_null(c: Column, value) -> Column:
    """``c != value`` that keeps rows where ``c`` is NULL."""
    return ~c.eqNullSafe(F.lit(value))


def round_half_even(c: Column, digits: int = 1) -> Column:
    return F.bround(c, digits)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL when ``b`` is 0."""
    return F.try_divide(a, b)


def clip(c: Column, lo, hi) -> Column:
    """Bound ``c``; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def tags_map(*names: str) -> Column:
    """Map from column name to that column's text."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def single_tag(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), value)


def merge_tags(a: Column, b: Column) -> Column:
    """Union of two maps; the right one wins on a shared key, NULL if either is NULL."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def category_levels(c: Column, n: int = 3) -> list[Column]:
    """First ``n`` parts of a dotted category as L1..Ln; missing parts are NULL."""
    parts = F.split(F.nullif(c, F.lit("")), "[.]")
    return [F.get(parts, F.lit(i)).alias(f"L{i + 1}") for i in range(n)]


def one_hot(col: str, levels, prefix: str | None = None, drop_first: bool = False) -> list[Column]:
    """One 0/1 column per declared level, also for levels the data lacks.

    ``drop_first`` leaves out the alphabetically first level. Without a prefix
    the level itself names the column.
    """
    names = sorted(str(v) for v in levels)[1:] if drop_first else [str(v) for v in levels]
    text = F.col(f"`{col}`").cast("string")
    return [
        F.coalesce((text == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}" if prefix else v)
        for v in names
    ]


def standardized(c: Column, mean: float, deviation: float) -> Column:
    """``(c - mean) / deviation``; 0 for a constant column, NULL for NULL."""
    if not deviation:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (c - F.lit(mean)) / F.lit(deviation)


def unit_interval(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends only on the given values."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)
