"""Conditions, null semantics and bit operators."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Any) -> Column:
    """Column names stay columns; everything else is a literal."""
    return c if isinstance(c, Column) else F.lit(c)


def iif(condition: Column, yes: Any, no: Any = None) -> Column:
    """A null condition takes the second branch."""
    return F.when(condition, col(yes)).otherwise(col(no))


def switch(*pairs: tuple[Column, Any], default: Any = None) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, col(value)) if out is None else out.when(condition, col(value))
    return out.otherwise(col(default))


def equal(a: Any, b: Any) -> Column:
    """Two-valued equality: nulls equal each other and nothing else."""
    return col(a).eqNullSafe(col(b))


def not_equal(a: Any, b: Any) -> Column:
    return ~col(a).eqNullSafe(col(b))


def coalesce(*values: Any) -> Column:
    return F.coalesce(*map(col, values))


def greatest(*values: Any) -> Column:
    """Fold of iif(a > b, a, b): a comparison with null is not true, so the next operand wins."""
    return reduce(lambda a, b: iif(a > b, a, b), map(col, values))


def least(*values: Any) -> Column:
    return reduce(lambda a, b: iif(a < b, a, b), map(col, values))


def in_list(c: Column, values: list | None) -> Column:
    """A null or empty list holds nothing; a null member matches null."""
    known = [v for v in values or [] if v is not None]
    out = c.isin(known) & c.isNotNull() if known else F.lit(False)
    return out | c.isNull() if values and len(known) < len(values) else out


def not_in_list(c: Column, values: list | None) -> Column:
    return ~in_list(c, values)


def escape_like(text: str) -> str:
    """A literal as a pattern for ``like`` with escape ``\\``."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in text)


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    return F.like(c, F.lit(pattern), F.lit(escape))


def band(a: Any, b: Any) -> Column:
    return col(a).bitwiseAND(col(b))


def bor(a: Any, b: Any) -> Column:
    return col(a).bitwiseOR(col(b))


def bxor(a: Any, b: Any) -> Column:
    return col(a).bitwiseXOR(col(b))


def bnot(a: Any) -> Column:
    return F.bitwise_not(col(a))


def has_flag(a: Any, flag: int) -> Column:
    return col(a).bitwiseAND(F.lit(flag)) == F.lit(flag)


def typed_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def count_in(values: list, predicate) -> Column:
    """How many members of an inline list the predicate (a function of a column) holds for, row by row."""
    if not values:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(col, values)), lambda v: F.coalesce(predicate(v), F.lit(False))))


def serialised(values: list | None) -> str | None:
    """A whole collection as the text that a collection column keeps."""
    import json

    return None if values is None else json.dumps(values, separators=(",", ":"))


def collection_equal(c: Column, values: list | None) -> Column:
    """Whether a collection column (text) is the whole list ``values``."""
    return c.eqNullSafe(F.lit(serialised(values)))
