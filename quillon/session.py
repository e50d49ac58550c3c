"""Session factory: UTC, adaptive execution, and partitions sized to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "quillon", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the functions here assume. Settings that the cluster has made stay unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
