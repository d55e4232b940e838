"""Quality rules with thresholds learned per language and source.

1. Every text gets integer measures in place, with built-in functions only:
   arrays inside the row, no exploding and no shuffle. They are written once,
   without the text.
2. Each (language, source, measure) gets a quantile sketch: a histogram with 32
   bins to every power of two, so a quantile is off by a 32nd at most. Sketches
   merge by adding counts; those of a language, and of everything, are sums of
   the finer ones. Counts combine before the shuffle, so a source that holds a
   third of all rows sends a few hundred bins from each task.
3. Fences of a group are its quartiles plus three times their distance and a
   margin. A group of fewer than ``least`` documents takes its language's
   fences, a smaller language those of everything.
4. The fences are joined to the measures. Fixed rules catch texts that are too
   short or mostly repeated; such texts are left out of the sketches.

Cases: a null text has no words and fails; null languages and sources are
values like any other; repeated rows count and are judged one by one; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import scratch_path

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
LEAST = 200
#: Measure: lower margin (None: no lower fence) and upper margin, below the fixed rules where there is one.
MEASURES = {"symbol_share": (None, 150), "dup_line_share": (None, 400), "repeat_share": (None, 250), "word_length": (150, 150)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _covered(hashes: Column, window: int) -> Column:
    """Words in windows whose hash occurs twice or more, from the array of window hashes."""

    def positions(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)))
            | (F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1), p + window) - p))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _let(_let(ordered, positions), total)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated).otherwise(0)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the text has twice or more."""

    def windows(codes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(codes) - (window - 1)), lambda i: F.xxhash64(F.slice(codes, i, window))
        )

    codes = F.transform(words, lambda w: F.xxhash64(w))
    hashed = _let(codes, lambda c: F.when(F.size(c) >= window, windows(c)).otherwise(F.array().cast("array<bigint>")))
    return _let(hashed, lambda h: _covered(h, window)).cast("long")


def _line_counts(text: Column) -> Column:
    """Struct of the lines with a word (n) and those equal to an earlier one (dup)."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    return _let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Id, language, source and the measures of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = _let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        counts.alias("w"), _line_counts(F.col(text_col)).alias("l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    return rows.select(
        "id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.dup").alias("n_dup_lines"), F.col("l.n").alias("n_lines"), F.col("w.repeat").alias("n_repeat_words"),
    ).withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "symbol_share": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "dup_line_share": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeat_share": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    })


def bin_of(value: Column) -> Column:
    """Histogram bin of a whole number from 0: itself below 32, then 32 to every power of two."""
    power = F.length(F.bin(value)) - 6
    return F.when(value < 32, value).otherwise(32 * power + F.call_function("shiftright", value, F.greatest(power, F.lit(0))))


def top_of(bin_: Column) -> Column:
    """Largest number of a bin."""
    power = F.greatest(F.floor(bin_ / 32) - 1, F.lit(0)).cast("int")
    return F.when(bin_ < 32, bin_).otherwise(F.call_function("shiftleft", (bin_ - 32 * power + 1).cast("long"), power) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bin, count): sketches of groups (0), languages (1) and everything (2)."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).cast("long").alias("bin")) for m in MEASURES)))
    finest = rows.where("not base_failed").select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.measure", "c.bin").agg(F.count("*").alias("count"))
    none = F.lit(None).cast("string")
    levels = F.explode(F.array(*(
        F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
        for k, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))
    )))
    return finest.select(levels.alias("g"), "measure", "bin", "count").groupBy("g.level", "g.lang", "g.source", "measure", "bin").agg(F.sum("count").alias("count"))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, <measure>_low, <measure>_high) of every sketch."""
    group = ["level", "lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("count").over(upto), "n": F.sum("count").over(Window.partitionBy(*group))})
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("n"), top_of(F.col("bin"))))
    cut = ranked.groupBy(*group).agg(F.max("n").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = 3 * (F.col("q3") - F.col("q1"))
    columns = []
    for m, (low, high) in MEASURES.items():
        own = F.col("measure") == m
        columns.append(F.max(F.when(own, F.col("q3") + reach + high)).alias(f"{m}_high"))
        columns.append(F.max(F.when(own, F.col("q1") - reach - low)).alias(f"{m}_low") if low else F.lit(None).cast("long").alias(f"{m}_low"))
    return cut.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *columns)


def adaptive_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least: int = LEAST,
) -> DataFrame:
    """One row per document: id, the measures, ``base_failed``, ``level`` of the fences used, and ``kept``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "quality")
    measures(docs, id_col, text_col, lang_col, source_col).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    fences(sketches(rows)).write.parquet(f"{path}/fences")
    cuts = spark.read.parquet(f"{path}/fences")
    names = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    at = lambda k: cuts.where(F.col("level") == k)
    own = F.struct("level", "n", *names)
    groups = at(0).select("lang", "source", own.alias("g0"))
    by_lang = at(1).select("lang", own.alias("g1"))
    whole = at(2).select(own.alias("g2"), F.lit(True).alias("any"))
    chosen = (
        groups.join(by_lang, groups["lang"].eqNullSafe(by_lang["lang"])).drop(by_lang["lang"])
        .withColumn("any", F.lit(True)).join(whole, "any")
        .select(
            F.col("lang").alias("l"), F.col("source").alias("s"),
            F.when(F.col("g0.n") >= least, F.col("g0")).when(F.col("g1.n") >= least, F.col("g1")).otherwise(F.col("g2")).alias("f"),
        )
    )
    chosen.write.parquet(f"{path}/chosen")
    chosen = spark.read.parquet(f"{path}/chosen")
    inside = reduce(
        lambda a, b: a & b,
        [F.col(m) <= F.col(f"f.{m}_high") for m in MEASURES] + [F.col(m) >= F.col(f"f.{m}_low") for m, (low, _) in MEASURES.items() if low],
    )
    joined = rows.join(chosen, rows["lang"].eqNullSafe(chosen["l"]) & rows["source"].eqNullSafe(chosen["s"]), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.col("f.level").alias("level"), *MEASURES,
    )
