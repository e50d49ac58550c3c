"""Dates and times. Times of day are whole seconds since midnight."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.logic import col

_PARTS = {"yyyy": F.year, "q": F.quarter, "m": F.month, "d": F.day, "y": F.dayofyear, "h": F.hour, "n": F.minute, "s": F.second, "w": F.dayofweek}
_UNITS = {"yyyy": "YEAR", "q": "QUARTER", "m": "MONTH", "d": "DAY", "y": "DAY", "w": "DAY", "ww": "WEEK", "h": "HOUR", "n": "MINUTE", "s": "SECOND"}
_SECONDS = {"h": 3600, "n": 60, "s": 1}


def date_part(part: str, x: Column) -> Column:
    """Parts are named as in the dialect: yyyy q m d y h n s, and w with Sunday as 1."""
    return _PARTS[part](x)


def day_of_week(x: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(x) - 1


def date_add(part: str, n: Any, x: Column) -> Column:
    """A null count adds nothing; months end at the month's last day."""
    return F.timestamp_add(_UNITS[part], F.coalesce(col(n).cast("int"), F.lit(0)), x)


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of ``part`` crossed from ``a`` to ``b``."""
    if part == "yyyy":
        return F.year(b) - F.year(a)
    if part == "q":
        return 4 * (F.year(b) - F.year(a)) + F.quarter(b) - F.quarter(a)
    if part == "m":
        return 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a)
    if part in ("d", "y"):
        return F.datediff(F.to_date(b), F.to_date(a))
    k = _SECONDS[part]
    unit = lambda x: F.floor(F.unix_seconds(x.cast("timestamp")) / k)
    return unit(b) - unit(a)


def date_only_add(part: str, n: Any, x: Column) -> Column:
    """``date_add`` of a date, as a date."""
    return F.to_date(date_add(part, n, x.cast("timestamp")))


def date_of(x: Column) -> Column:
    return F.date_trunc("DAY", x)


def date_only(x: Column) -> Column:
    return F.to_date(x)


def day_number(x: Column) -> Column:
    """Days since 0001-01-01."""
    return F.datediff(F.to_date(x), F.make_date(F.lit(1), F.lit(1), F.lit(1)))


def time_of_day(x: Column) -> Column:
    return F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)


def time_part(part: str, seconds: Column) -> Column:
    k = _SECONDS[part]
    return F.floor(seconds / k).cast("int") if part == "h" else F.floor(seconds / k).cast("int") % 60


def time_add(part: str, n: Any, seconds: Column) -> Column:
    """Wraps at midnight."""
    return F.pmod(seconds + (col(n) * _SECONDS[part]).cast("int"), F.lit(86400))


def time_between(x: Column, a: Any, b: Any) -> Column:
    """From ``a`` to before ``b``."""
    return (x >= col(a)) & (x < col(b))


def seconds(text: str) -> int:
    """'HH:mm:ss' as seconds."""
    h, m, s = map(int, text.split(":"))
    return h * 3600 + m * 60 + s


def span_diff(part: str, a: Column, b: Column) -> Column:
    k = _SECONDS[part]
    return F.floor(b / k) - F.floor(a / k)


def date_serial(year: Any, month: Any, day: Any) -> Column:
    return F.make_date(col(year), col(month), col(day))


def to_datetime(date: Column, time: Any) -> Column:
    """A date and a time of day."""
    return F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + col(time))


def unix_seconds(x: Column) -> Column:
    return F.unix_seconds(x.cast("timestamp"))


def unix_millis(x: Column) -> Column:
    return F.unix_millis(x.cast("timestamp"))


def now() -> Column:
    return F.current_timestamp()


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def today() -> Column:
    return F.current_date()


def is_date(s: Column) -> Column:
    """Whether a text reads as a date or timestamp; null does not."""
    return s.isNotNull() & F.try_to_timestamp(s).isNotNull()
