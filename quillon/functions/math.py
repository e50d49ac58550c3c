"""Mathematics. Names with ``fix`` follow the dialect's formulas; the mathematical functions stand beside them."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.logic import col

absolute, exp, sqrt, atan, cos, sin, tan, acos, asin, atan2, ceil, floor = F.abs, F.exp, F.sqrt, F.atan, F.cos, F.sin, F.tan, F.acos, F.asin, F.atan2, F.ceil, F.floor


def power(x: Any, y: Any) -> Column:
    return F.pow(col(x), col(y))


def log(x: Column, base: Any = None) -> Column:
    return F.ln(x) if base is None else F.ln(x) / F.ln(col(base))


def log10(x: Column) -> Column:
    return F.ln(x) / math.log(10)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def fix(x: Column) -> Column:
    """Whole part, toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fix_floor(x: Column) -> Column:
    """The dialect's floor is ``fix``: it differs from ``floor`` below zero."""
    return fix(x)


def fix_ceiling(x: Column) -> Column:
    """iif(fix(x) = x, fix(x), fix(x) + 1): one more than ``ceil`` for negative fractions."""
    return F.when(fix(x) == x, fix(x)).otherwise(fix(x) + 1)


def atan_ratio(y: Column, x: Column) -> Column:
    """atan(y / x), without quadrants."""
    return F.atan(y / x)


def acos_formula(x: Column) -> Column:
    """pi/2 + atan(-x / sqrt(1 - x*x)); null where that divides by zero (+-1)."""
    root = F.sqrt(-x * x + 1)
    return math.pi / 2 + F.atan(F.when(root != 0, -x / root))


def asin_formula(x: Column) -> Column:
    root = F.sqrt(-x * x + 1)
    return F.atan(F.when(root != 0, x / root))


def radians(x: Column) -> Column:
    return x * (math.pi / 180)


def degrees(x: Column) -> Column:
    return x * (180 / math.pi)


def round_even(x: Column, digits: int = 0) -> Column:
    """Halves go to the even digit."""
    return F.bround(x, digits)


def int_div(a: Any, b: Any) -> Column:
    """The dialect's ``\\``: whole division toward zero; null for a zero divisor."""
    a, b = col(a), col(b)
    return ((a - mod(a, b)) / F.when(b != 0, b)).cast("long")


def mod(a: Any, b: Any) -> Column:
    """The remainder has the dividend's sign."""
    return F.try_mod(col(a), col(b))


def random(seed: int | None = None) -> Column:
    return F.rand(seed)
