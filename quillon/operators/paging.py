"""Pages that no single task has to hold."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark numbers a partition's rows from its index shifted by so many bits.
_BITS = 33


def rows_after(df: DataFrame, n: int) -> DataFrame:
    """``df`` without its first ``n`` rows, in its order: what OFFSET gives, which Spark passes through one task.

    The rows are put down once as they are sorted, each with its place; counts by partition say at which place the page begins.  This runs when it is
    called.  The rows lie in ``spark.checkpoint.dir``, or on the executors' disks where that is unset, as long as the result is in use.
    """
    if n == 0:
        return df
    place = "place__"
    while place in (c.lower() for c in df.columns):
        place += "_"
    placed = df.withColumn(place, F.monotonically_increasing_id())
    if df.sparkSession.sparkContext.getCheckpointDir():
        placed = placed.checkpoint()
    else:
        placed = placed.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    begin = None
    for part, rows in sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright(place, _BITS)).count().collect()):
        if n < rows:
            begin = (part << _BITS) + n
            break
        n -= rows
    return placed.where(F.lit(False) if begin is None else F.col(place) >= begin).drop(place)
