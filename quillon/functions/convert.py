"""Conversions; null stays null."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F



def cbool(x: Column) -> Column:
    return x.cast("double") != 0


def _whole(x: Column, kind: str) -> Column:
    """Fractions round half to even; what is out of range is null."""
    return F.bround(x.try_cast("double"), 0).try_cast(kind)


def cbyte(x: Column) -> Column:
    w = _whole(x, "int")
    return F.when(w.between(0, 255), w.cast("smallint"))


def cint(x: Column) -> Column:
    return _whole(x, "smallint")


def clng(x: Column) -> Column:
    return _whole(x, "int")


def csng(x: Column) -> Column:
    return x.try_cast("float")


def cdbl(x: Column) -> Column:
    return x.try_cast("double")


def cdec(x: Column, precision: int = 18, scale: int = 2) -> Column:
    return x.try_cast(f"decimal({precision},{scale})")


def cdate(x: Column) -> Column:
    return x.try_cast("timestamp")


def cstr(x: Column) -> Column:
    return x.cast("string")


def new_guid() -> Column:
    """One value for the whole query."""
    return F.lit(str(uuid.uuid4()))


def sequential_guids(n: int, start: int | None = None) -> list[str]:
    """Identifiers that sort in the order made."""
    import time

    at = start if start is not None else time.time_ns()
    return [f"{(at + i) >> 32 & 0xFFFFFFFF:08x}-{(at + i) >> 16 & 0xFFFF:04x}-{(at + i) & 0xFFFF:04x}-{uuid.uuid4().hex[:4]}-{uuid.uuid4().hex[:12]}" for i in range(n)]
