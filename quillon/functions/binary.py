"""Byte strings."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.logic import col


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def byte_at(x: Column, i: Any) -> Column:
    """Unsigned value of the byte at a zero-based place; null beyond the end."""
    h = F.hex(F.substr(x, col(i) + 1, F.lit(1)))
    return F.when(h != "", F.conv(h, 16, 10).cast("int"))


def first_byte(x: Column) -> Column:
    return byte_at(x, 0)


def contains_byte(x: Column, value: int) -> Column:
    """Pairs of hexadecimal digits are separated, so a match cannot straddle two bytes."""
    return F.concat(F.lit(" "), F.regexp_replace(F.hex(x), "(..)", "$1 ")).contains(f" {value:02X} ")


def sequence_equal(a: Column, b: Any) -> Column:
    return a == col(b)
