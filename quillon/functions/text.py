"""Text functions. Positions are zero-based; a null argument gives null unless stated."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.logic import col, escape_like, like

length, lower, upper = F.length, F.lower, F.upper


def trim(s: Column) -> Column:
    """Spaces only, at both ends."""
    return F.trim(s)


def trim_start(s: Column) -> Column:
    return F.ltrim(s)


def trim_end(s: Column) -> Column:
    return F.rtrim(s)


def index_of(s: Column, part: Any, start: Any = 0) -> Column:
    """First place of ``part`` at or after ``start``, ignoring case, or -1; an empty part is found at 0."""
    part = col(part)
    at = F.call_function("locate", F.lower(part), F.lower(s), col(start).cast("int") + 1) - 1
    return F.when(s.isNull() | part.isNull(), F.lit(None).cast("int")).when(part == "", F.lit(0)).otherwise(at)


def contains(s: Column, part: Any) -> Column:
    """A literal is matched exactly; a column ignoring case, false where either is null."""
    if isinstance(part, Column):
        return s.isNotNull() & part.isNotNull() & ((part == "") | (F.instr(F.lower(s), F.lower(part)) > 0))
    return F.lit(None).cast("boolean") if part is None else s.contains(part)


def starts_with(s: Column, part: Any) -> Column:
    if isinstance(part, Column):
        return s.isNotNull() & part.isNotNull() & s.startswith(part)
    return F.lit(None).cast("boolean") if part is None else s.startswith(part)


def ends_with(s: Column, part: Any) -> Column:
    if isinstance(part, Column):
        return s.isNotNull() & part.isNotNull() & s.endswith(part)
    return F.lit(None).cast("boolean") if part is None else s.endswith(part)


def like_literal(s: Column, part: str, before: bool = True, after: bool = True) -> Column:
    """``part`` as a pattern whose wildcards are escaped."""
    return like(s, ("%" if before else "") + escape_like(part) + ("%" if after else ""))


def replace(s: Column, old: Any, new: Any) -> Column:
    return F.replace(s, col(old), col(new))


def substring(s: Column, start: Any, count: Any = None) -> Column:
    """``start`` -1 counts as 0."""
    start = col(start)
    at = F.when(start == -1, 0).otherwise(start) + 1
    return F.substr(s, at) if count is None else F.substr(s, at, col(count))


def first_char(s: Column) -> Column:
    return F.substr(s, F.lit(1), F.lit(1))


def last_char(s: Column) -> Column:
    return F.right(s, F.lit(1))


def is_null_or_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def is_null_or_whitespace(s: Column, strict: bool = False) -> Column:
    """Without ``strict`` only the empty text counts, as where padding is ignored by comparison."""
    return s.isNull() | ((F.trim(s) if strict else s) == "")


def join_values(separator: str, *values: Any) -> Column:
    """Row-wise join; nulls are empty and keep their place."""
    return F.concat_ws(separator, *[F.coalesce(col(v).cast("string"), F.lit("")) for v in values])


def concat(*values: Any) -> Column:
    return F.concat(*[col(v).cast("string") for v in values])


def concat_amp(*values: Any) -> Column:
    """The dialect's ``&``: null is empty."""
    return F.concat(*[F.coalesce(col(v).cast("string"), F.lit("")) for v in values])


def compare(a: Any, b: Any) -> Column:
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def to_text(c: Column, boolean: bool = False) -> Column:
    """Null is the empty text; booleans are True and False."""
    if boolean:
        return F.when(c, "True").when(~c, "False").otherwise("")
    return F.coalesce(c.cast("string"), F.lit(""))
