"""Hand-made edge cases of the column functions."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C, frames as T


def one(spark, **cols):
    return [list(r) for r in spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()][0]


def day(text):
    return F.lit(text).cast("date")


def test_delay_and_status(spark):
    due = day("2020-01-10")
    delays = [C.payment_delay(due, day(p)) for p in ("2020-01-07", "2020-01-10", "2020-01-12")]
    delays.append(C.payment_delay(due, F.lit(None).cast("date")))
    got = one(spark, **{f"d{i}": d for i, d in enumerate(delays)}, **{f"s{i}": C.payment_status(d) for i, d in enumerate(delays)})
    assert got == [3, 0, -2, None, "early", "ontime", "late", "NA"]


def test_fractional_days_fall_on_the_day_before(spark):
    got = one(spark, a=C.add_days(day("2020-01-10"), F.lit(-0.5)), b=C.add_days(day("2020-01-10"), F.lit(1.9)))
    assert got == [dt.date(2020, 1, 9), dt.date(2020, 1, 11)]


def test_half_even(spark):
    assert one(spark, a=C.round_half_even(F.lit(0.25)), b=C.round_half_even(F.lit(0.35))) == [0.2, 0.4]


def test_levels(spark):
    def levels(text):
        return one(spark, **{str(i): c for i, c in enumerate(C.category_levels(F.lit(text)))})

    assert levels("a.b") == ["a", "b", None]
    assert levels("") == [None, None, None]
    assert levels("a.b.c.d") == ["a", "b", "c"]


def test_tags_right_side_wins(spark):
    a = F.create_map(F.lit("a"), F.lit("1"), F.lit("z"), F.lit("0"))
    assert one(spark, t=C.merge_tags(a, C.single_tag("a", F.lit("2")))) == [{"a": "2", "z": "0"}]


def test_dates(spark):
    assert one(spark, a=C.parse_us_date(F.lit("1/5/2020")), b=C.parse_us_date(F.lit(""))) == [dt.date(2020, 1, 5), None]
    texts = ["2020-01-05", "2020-01-05 10:11:12", "1/5/2020", "5-Jan-2020", "2020/1/5"]
    got = one(spark, **{f"t{i}": C.parse_any_date(F.lit(t)) for i, t in enumerate(texts)}, bad=C.parse_any_date(F.lit("soon")))
    assert got == [dt.date(2020, 1, 5)] * 5 + [None]


def test_strict_date_raises(spark):
    with pytest.raises(PySparkException):
        one(spark, a=C.parse_us_date(F.lit("soon")))


def test_iso_year_and_week(spark):
    assert one(spark, y=C.iso_year(day("2021-01-03")), w=C.week_of(day("2021-01-03"))) == [2020, 53]


def test_null_keeping_filter(spark):
    df = spark.createDataFrame([(None,), ("Unpaid",), ("Paid",)], "s string")
    assert {r.s for r in df.where(C.ne_or_null(F.col("s"), "Unpaid")).collect()} == {None, "Paid"}


def test_zero_denominator_and_clip(spark):
    got = one(spark, a=C.safe_ratio(F.lit(1.0), F.lit(0.0)), b=C.clip(F.lit(9.0), 0.0, 5.0), c=C.clip(F.lit(None).cast("double"), 0.0, 5.0))
    assert got == [None, 5.0, None]


def test_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    got = [list(r) for r in df.select(*C.one_hot("c", ["a", "b", "z"])).collect()]
    assert got == [[1, 0, 0], [0, 1, 0], [0, 0, 0]]
    assert df.select(*C.one_hot("c", ["b", "a"], "c", drop_first=True)).columns == ["c_b"]


def test_frames(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id bigint, v double, City string")
    assert T.key_first(df, "v").columns == ["v", "id", "City"]
    assert T.split_by_type(df, categorical=("id",)) == (["id", "City"], ["v"])
    assert T.numeric_only(df).columns == ["id", "v"]
    assert dict(T.cast_by_type(df, {"double": "float"}).dtypes)["v"] == "float"
    assert T.flatten_struct(T.pack(df), "value").collect() == df.collect()
    lenient = T.cast_columns(df, {"City": "int"}, strict=False)
    assert lenient.first().City is None
