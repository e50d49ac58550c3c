"""Recipes that turn shaped data into relations: hierarchies, includes, links, fragments and filters."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def of_type(df: DataFrame, discriminator: str, *kinds: str) -> DataFrame:
    """Rows of some kinds of a hierarchy kept in one table."""
    return df.where(F.col(discriminator).isin(*kinds))


def per_type(base: DataFrame, key: str, **kinds: DataFrame) -> DataFrame:
    """A hierarchy of one table a type: the base with its parts, and ``type_tag`` of the most derived part, later ones first."""
    tag, out = None, base
    for name, part in kinds.items():
        part = part.withColumnRenamed(key, f"{name}__key")
        out = out.join(part, F.col(key) == F.col(f"{name}__key"), "left")
    for name in reversed(kinds):
        hit = F.col(f"{name}__key").isNotNull()
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return out.withColumn("type_tag", tag).drop(*[f"{n}__key" for n in kinds])


def per_concrete_type(**kinds: DataFrame) -> DataFrame:
    """A hierarchy of one table a concrete type: branches padded with typed nulls."""
    out = None
    for name, part in kinds.items():
        part = part.withColumn("type_tag", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def include(parent: DataFrame, child: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Parents with an array of their children, ordered by all of the child's columns."""
    nested = child.groupBy(F.col(foreign).alias("include_key__")).agg(F.array_sort(F.collect_list(F.struct(*child.columns))).alias(name))
    out = parent.join(nested, F.col(key) == F.col("include_key__"), "left").drop("include_key__")
    return out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def split_include(parent: DataFrame, child: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents, and the children of those parents, as two queries."""
    return parent, child.join(parent.select(F.col(key).alias("split_key__")).distinct(), F.col(foreign) == F.col("split_key__"), "left_semi")


def through(left: DataFrame, link: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """Many to many: left rows with the right rows that a link table gives them; left rows without any stay."""
    pairs = link.join(right, F.col(right_on[0]) == F.col(right_on[1]))
    return left.join(pairs, F.col(left_on[0]) == F.col(left_on[1]), "left")


def fragments(key: str, *parts: DataFrame) -> DataFrame:
    """One entity kept in several tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


def owned(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Columns gathered into a struct; ``flat`` undoes it."""
    return df.withColumn(name, F.struct(*columns)).drop(*columns)


def flat(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    fields = df.schema[name].dataType.names
    return df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{f}").alias(prefix + f) for f in fields])


class Model:
    """Named sources with filters that hold wherever a source is read."""

    def __init__(self, **sources: DataFrame) -> None:
        self.sources, self.filters = sources, {}

    def filter(self, name: str, condition: Column | Callable[..., Column]) -> Model:
        """A condition, or a function of parameters that gives one."""
        self.filters[name] = condition
        return self

    def read(self, name: str, unfiltered: bool = False, **parameters: Any) -> DataFrame:
        df = self.sources[name]
        if unfiltered or name not in self.filters:
            return df
        condition = self.filters[name]
        return df.where(condition if isinstance(condition, Column) else condition(**parameters))


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs that run within the block show the tag; the description before comes back after it."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setLocalProperty("spark.job.description", tag)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)
