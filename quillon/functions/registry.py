"""Scalar functions of the user, as SQL functions of the session: inlined into plans, no Python at run time."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from quillon.plans import dialect


def define(spark: SparkSession, name: str, parameters: dict[str, str], returns: str, body: str) -> None:
    """``body`` is an expression of the dialect over the parameters (name to Spark type); queries of both dialects and ``F.call_function`` may call it."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a function name: {name!r}")
    args = ", ".join(f"{p} {t}" for p, t in parameters.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {dialect.translate_expression(body)}")


def remove(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
