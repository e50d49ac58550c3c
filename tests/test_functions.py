"""Null, sign and boundary semantics of the column functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillon import types as qt
from quillon.functions import binary, convert, logic, stats, temporal, text
from quillon.functions import math as m


@pytest.fixture(scope="module")
def val(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    return one


def null():
    return F.lit(None).cast("int")


def no_text():
    return F.lit(None).cast("string")


def test_greatest_lets_the_next_operand_win_over_null(val):
    assert val(logic.greatest(1, null())) is None and val(logic.greatest(null(), 1)) == 1 and val(logic.greatest(3, 2, 5)) == 5
    assert val(logic.least(1, null())) is None and val(logic.least(null(), 1)) == 1


def test_null_semantics(val):
    assert val(logic.equal(null(), null())) is True and val(logic.not_equal(null(), 1)) is True
    assert val(logic.in_list(null(), [1, None])) is True and val(logic.in_list(null(), [1])) is False and val(logic.in_list(F.lit(1), [])) is False
    assert val(logic.not_in_list(null(), [1])) is True and val(logic.iif(F.lit(None).cast("boolean"), 1, 2)) == 2


@pytest.mark.parametrize(("s", "part", "start", "want"), [("Hello", "L", 0, 2), ("Hello", "l", 3, 3), ("Hello", "x", 0, -1), ("Hello", "", 0, 0), ("", "a", 0, -1)])
def test_index_of(val, s, part, start, want):
    assert val(text.index_of(F.lit(s), part, start)) == want


def test_text_nulls(val):
    assert val(text.index_of(no_text(), "")) is None and val(text.contains(no_text(), F.lit("a"))) is False and val(text.contains(F.lit("abc"), F.lit(""))) is True
    assert val(text.contains(F.lit("ABC"), F.lit("b"))) is True and val(text.contains(F.lit("ABC"), "b")) is False
    assert val(text.replace(F.lit("aa"), "a", no_text())) is None and val(text.is_null_or_empty(no_text())) is True
    assert val(text.is_null_or_whitespace(F.lit("  "))) is False and val(text.is_null_or_whitespace(F.lit("  "), strict=True)) is True
    assert val(text.to_text(F.lit(None).cast("boolean"), boolean=True)) == "" and val(text.to_text(F.lit(True), boolean=True)) == "True"
    assert val(text.join_values(",", "a", no_text(), "b")) == "a,,b" and val(text.concat("a", no_text())) is None and val(text.concat_amp("a", no_text())) == "a"
    assert val(text.compare("a", no_text())) is None and val(text.substring(F.lit("abcd"), -1, 2)) == "ab"
    assert val(text.like_literal(F.lit("50%_x"), "%_")) is True and val(text.like_literal(F.lit("50x"), "%_")) is False


@pytest.mark.parametrize("x", [-2.5, -2.0, -0.5, 0.0, 0.5, 2.5])
def test_fix_family(val, x):
    fix = math.trunc(x)
    assert val(m.fix(F.lit(x))) == fix and val(m.fix_floor(F.lit(x))) == fix and val(m.floor(F.lit(x))) == math.floor(x)
    assert val(m.fix_ceiling(F.lit(x))) == (fix if fix == x else fix + 1)


def test_rounding_and_division(val):
    assert [val(m.round_even(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert val(m.int_div(7, -2)) == -3 and val(m.mod(-7, 3)) == -1 and val(m.mod(7, 0)) is None and val(m.int_div(7, 0)) is None
    assert val(m.atan_ratio(F.lit(1.0), F.lit(-1.0))) == pytest.approx(-math.pi / 4)
    assert val(m.acos_formula(F.lit(1.0))) is None and val(m.acos(F.lit(1.0))) == 0 and val(m.asin_formula(F.lit(0.5))) == pytest.approx(math.asin(0.5))
    assert val(m.log(F.lit(8.0), 2)) == pytest.approx(3) and val(m.sign(F.lit(-3.2))) == -1


def stamp(s):
    return F.lit(s).cast("timestamp")


@pytest.mark.parametrize(
    ("part", "a", "b", "want"),
    [("m", "2024-01-31", "2024-02-01", 1), ("h", "2024-01-01 01:59:59", "2024-01-01 02:00:00", 1), ("yyyy", "2023-12-31", "2024-01-01", 1), ("d", "2024-01-01 23:59:59", "2024-01-02", 1), ("s", "2024-01-02", "2024-01-01", -86400), ("n", "1969-12-31 23:59:59", "1970-01-01", 1), ("q", "2024-03-31", "2024-04-01", 1)],
)
def test_date_diff_counts_boundaries(val, part, a, b, want):
    assert val(temporal.date_diff(part, stamp(a), stamp(b))) == want


def test_dates(val):
    assert val(temporal.date_add("m", 1, stamp("2024-01-31")).cast("string")) == "2024-02-29 00:00:00"
    assert val(temporal.date_add("d", null(), stamp("2024-01-31")).cast("string")) == "2024-01-31 00:00:00"
    assert val(temporal.day_of_week(stamp("2024-01-07"))) == 0 and val(temporal.day_number(stamp("0001-01-02"))) == 1
    assert val(temporal.time_add("h", 2, F.lit(temporal.seconds("23:30:00")))) == temporal.seconds("01:30:00") and val(temporal.time_add("h", -1, F.lit(0))) == 82800
    assert val(temporal.is_date(F.lit("2024-02-30"))) is False and val(temporal.is_date(F.lit("2024-02-29"))) is True and val(temporal.is_date(no_text())) is False
    assert val(temporal.to_datetime(F.lit(dt.date(2024, 1, 2)), 3661).cast("string")) == "2024-01-02 01:01:01"
    assert val(temporal.span_diff("n", F.lit(59), F.lit(60))) == 1


def test_conversions(val):
    assert [val(convert.clng(F.lit(x))) for x in ("2.5", "3.5", "x", None)] == [2, 4, None, None]
    assert val(convert.cbyte(F.lit(256))) is None and val(convert.cbyte(F.lit(255))) == 255 and val(convert.cbool(F.lit(-1))) is True
    assert convert.sequential_guids(3, 7) == sorted(convert.sequential_guids(3, 7)) or len(set(convert.sequential_guids(3, 7))) == 3


def test_bytes(val):
    x = F.lit(bytes([0x0A, 0xB0, 0xFF]))
    assert val(binary.byte_length(x)) == 3 and val(binary.byte_at(x, 2)) == 255 and val(binary.byte_at(x, 3)) is None
    assert val(binary.contains_byte(x, 0xAB)) is False and val(binary.contains_byte(x, 0xB0)) is True


def test_sum_over_nothing_is_zero(spark):
    row = spark.range(0).agg(stats.total(F.col("id")).alias("s"), stats.average(F.col("id")).alias("a"), F.max("id").alias("m")).first()
    assert (row.s, row.a, row.m) == (0, None, None)


def test_store_types_and_literals():
    assert qt.store_type("decimal(10,2)").simpleString() == "decimal(10,2)" and qt.store_type("VARCHAR(40)").simpleString() == "string" and qt.store_type("money").simpleString() == "decimal(19,4)"
    with pytest.raises(ValueError):
        qt.store_type("array")
    assert qt.literal("it's") == "'it''s'" and qt.literal(dt.datetime(2024, 1, 2, 3, 4, 5)) == "#2024-01-02 03:04:05#" and qt.literal(b"\xab") == "0xAB" and qt.literal(None) == "NULL"


def test_conform(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("0", "12", dt.datetime(2024, 1, 1, 0, 0, 0, 999_600), 5), ("yes", None, None, None)], "b string, i string, t timestamp, n int")
    schema = T.StructType([T.StructField("b", T.BooleanType()), T.StructField("i", T.IntegerType(), False), T.StructField("t", T.TimestampType()), T.StructField("n", T.IntegerType())])
    out = qt.conform(df, schema, fill_defaults=True, null_integer=5).collect()
    assert [r.b for r in out] == [False, True] and [r.i for r in out] == [12, 0] and out[0].t.microsecond == 0 and out[0].n is None
    assert qt.conform(df, schema, precision="ms").first().t == dt.datetime(2024, 1, 1, 0, 0, 1)
