"""Places that the driver and all executors share, and tables that are written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return f"file://{_OWN['root']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"


#: For tables of whole texts: a writer holds a row group, and a reader a column of one, so every task of an executor has one or two on the heap.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20)}


#: Spark removes the files of a query's shuffles at its end; else they stay until the driver's heap happens to be collected.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A reader's batch holds the texts of so many rows, and twice that while it grows; Spark's 4,096 rows of 2 KB are 20 MB a task.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def holding(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Queries begun inside run with this setting; the session's own one holds again afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def swept(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries begun inside leave no shuffle files."""
    return holding(spark, SWEEP, "true")


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries begun inside read whole texts a few at a time."""
    return holding(spark, READ_ROWS, "256")


def written(df: DataFrame, name: str, partition_by: str | None = None, sweep: bool = False, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and with ``sweep`` its shuffle files go."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with swept(spark) if sweep else nullcontext():
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the cluster's owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
