"""A fluent query over a DataFrame.

Each step adds to the logical plan; nothing runs before ``collect``/``count``-like calls on ``df``, but for a skip without a take, whose rows are sorted and
put down when ``df`` or a next step asks for them.  Orderings are remembered, so ``last`` can turn
them round, and are applied when a limit, an offset or the end needs them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import stats
from quillon.operators.paging import rows_after
from quillon.options import current


class QueryError(ValueError):
    """A shape that the query surface refuses."""


class Query:
    def __init__(self, df: DataFrame, order: list[tuple[Column, bool]] | None = None) -> None:
        self._rows, self._order, self._skipped, self._offset = df, order or [], False, 0

    @property
    def _df(self) -> DataFrame:
        return rows_after(self._rows, self._offset)

    # sources

    @classmethod
    def values(cls, spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> Query:
        """An inline relation: equal rows count once."""
        return cls(spark.createDataFrame(rows, schema).distinct())

    @classmethod
    def one(cls, spark: SparkSession, **columns: Any) -> Query:
        """One row without a table."""
        return cls(spark.range(1).select(*[_lit(v).alias(k) for k, v in columns.items()]))

    @classmethod
    def sql(cls, spark: SparkSession, text: str, args: dict | None = None) -> Query:
        """Raw SQL to compose on."""
        if text.lstrip().lower().startswith("with"):
            raise QueryError("a raw query to compose on cannot begin with WITH")
        return cls(spark.sql(text, args=args))

    # shape

    @property
    def df(self) -> DataFrame:
        if self._skipped:
            raise QueryError("a skip needs a take")
        return self._page()

    def _page(self) -> DataFrame:
        if not self._order:
            return self._df
        return self._df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in self._order])

    def _with(self, df: DataFrame, keep_order: bool = True) -> Query:
        return Query(df, self._order if keep_order else None)

    def where(self, condition: Column | str) -> Query:
        return self._with(self._df.where(condition))

    def select(self, *columns: Column | str, **named: Any) -> Query:
        """Without columns: one constant, for queries that only count rows. Orderings by columns that go are applied first."""
        out = [F.col(c) if isinstance(c, str) else c for c in columns] + [_lit(v).alias(k) for k, v in named.items()]
        return Query(self.df.select(*out or [F.lit(1).alias("one")]))

    def extend(self, **named: Any) -> Query:
        return self._with(self._df.withColumns({k: _lit(v) for k, v in named.items()}))

    def distinct(self) -> Query:
        return self._with(self._df.distinct(), False)

    def alias(self, name: str) -> Query:
        return self._with(self._df.alias(name))

    # joins

    def _join(self, other: Query, on: Any, how: str) -> Query:
        if isinstance(on, dict):
            on = [F.col(a) == F.col(b) for a, b in on.items()]
        return self._with(self._df.join(other.df, on, how), False)

    def join(self, other: Query, on: Any) -> Query:
        """``on``: a condition, a list of them, or {left name: right name}. Equal keys of any number may be given."""
        return self._join(other, on, "inner")

    def left_join(self, other: Query, on: Any) -> Query:
        return self._join(other, on, "left")

    def right_join(self, other: Query, on: Any) -> Query:
        return self._join(other, on, "right")

    def cross(self, other: Query) -> Query:
        """All pairs: for small inputs and one-row relations."""
        return self._with(self._df.crossJoin(other.df), False)

    def exists_in(self, other: Query, on: Any) -> Query:
        return self._join(other, on, "left_semi")

    def not_exists_in(self, other: Query, on: Any) -> Query:
        return self._join(other, on, "left_anti")

    def in_query(self, column: str, other: Query, other_column: str) -> Query:
        """``column IN (subquery)``."""
        return self._join(Query(other.df.select(F.col(other_column).alias("in__"))), {column: "in__"}, "left_semi")

    def group_join(self, other: Query, key: str, other_key: str, name: str) -> Query:
        """Each row with the array of its matches (structs), empty without any."""
        kept = other.df
        groups = kept.groupBy(F.col(other_key).alias("group_key__")).agg(F.collect_list(F.struct(*kept.columns)).alias(name))
        joined = self._df.join(groups, F.col(key) == F.col("group_key__"), "left").drop("group_key__")
        empty = F.array().cast(groups.schema[name].dataType)
        return self._with(joined.withColumn(name, F.coalesce(name, empty)), False)

    # groups

    def group_by(self, *keys: Column | str) -> Grouped:
        return Grouped(self._df, keys)

    def aggregate(self, **named: Column) -> Query:
        return Query(self._df.agg(*[c.alias(k) for k, c in named.items()]))

    # order and paging

    def order_by(self, *keys: Column | str, desc: bool = False) -> Query:
        return Query(self._df, [(F.col(k) if isinstance(k, str) else k, desc) for k in keys])

    def order_by_desc(self, *keys: Column | str) -> Query:
        return self.order_by(*keys, desc=True)

    def then_by(self, *keys: Column | str, desc: bool = False) -> Query:
        if not self._order:
            raise QueryError("then_by needs order_by")
        return Query(self._df, self._order + [(F.col(k) if isinstance(k, str) else k, desc) for k in keys])

    def take(self, n: int) -> Query:
        _whole(n)
        if self._offset:
            return Query(self._rows.offset(self._offset).limit(n))
        return Query(self._page().limit(n))

    def skip(self, n: int) -> Query:
        """Rows after the first ``n``. Where the options forbid a skip alone, a take must follow."""
        _whole(n)
        out = Query(self.df)
        out._offset, out._skipped = n, not current().skip_alone
        return out

    def reverse(self) -> Query:
        if not self._order:
            raise QueryError("reverse needs an ordering")
        return Query(self._df, [(c, not d) for c, d in self._order])

    def first(self) -> Query:
        return self.take(1)

    def last(self) -> Query:
        return self.reverse().take(1)

    def element_at(self, i: int) -> Query:
        return self.skip(i).take(1)

    def single(self) -> Query:
        """At most one row may exist; two rows are enough to know."""
        out = self.take(2)
        if len(out.df.collect()) > 1:
            raise QueryError("more than one row")
        return out

    # sets

    def union(self, other: Query) -> Query:
        return Query(self.df.union(other.df).distinct())

    def concat(self, other: Query) -> Query:
        return Query(self.df.union(other.df))

    def intersect(self, other: Query) -> Query:
        return Query(self.df.intersect(other.df))

    def except_(self, other: Query) -> Query:
        return Query(self.df.subtract(other.df))

    # answers of one row

    def any(self, condition: Column | None = None) -> Query:
        rows = self._df if condition is None else self._df.where(condition)
        return Query(rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("value")))

    def all(self, condition: Column) -> Query:
        """No row for which the condition isn't true."""
        broken = self._df.where(~F.coalesce(condition, F.lit(False)))
        return Query(broken.limit(1).agg((F.count(F.lit(1)) == 0).alias("value")))

    def contains(self, column: str, value: Any) -> Query:
        return self.any(F.col(column).eqNullSafe(F.lit(value)))

    def count(self, condition: Column | None = None) -> Query:
        return self.aggregate(value=stats.count() if condition is None else stats.count_if(condition))

    def default_if_empty(self, spark: SparkSession) -> Query:
        return Query(spark.range(1).select().join(self._df, F.lit(True), "left"))


class Grouped:
    def __init__(self, df: DataFrame, keys: tuple) -> None:
        self._df, self._keys = df, [F.col(k) if isinstance(k, str) else k for k in keys]

    def aggregate(self, having: Column | None = None, **named: Column) -> Query:
        out = self._df.groupBy(*self._keys).agg(*[c.alias(k) for k, c in named.items()])
        return Query(out.where(having) if having is not None else out)

    def top(self, n: int, *order: Column) -> Query:
        """The first n rows of each group (a window; an addition to the grouping operators)."""
        from pyspark.sql import Window

        w = Window.partitionBy(*self._keys).orderBy(*order)
        return Query(self._df.withColumn("rank__", F.row_number().over(w)).where(F.col("rank__") <= n).drop("rank__"))


def prepared(build: Callable[..., Query], keep: int = 64) -> Callable[..., Query]:
    """A query with parameters whose plan for the same parameters is made once; the ``keep`` plans used last are kept."""
    made: OrderedDict = OrderedDict()

    def run(*args: Any, **kwargs: Any) -> Query:
        key = (args, tuple(sorted(kwargs.items())))
        if key not in made:
            made[key] = build(*args, **kwargs)
        made.move_to_end(key)
        if len(made) > keep:
            made.popitem(last=False)
        return made[key]

    run.made = made

    return run


def _lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _whole(n: Any) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise QueryError("limits and offsets are whole numbers, not columns")
