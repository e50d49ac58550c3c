"""Line deduplication over levelled sorted runs of line hashes.

Each batch of documents is counted by line hash and merge-joined with the runs so far.  The join decides where a hash goes: unseen ones (the anti-join) are
the batch's own run, so runs never share a hash; those that a run holds already are kept beside it as additions (more documents, a larger
last doc_id).  Runs are tables bucketed and sorted by hash, so they are neither shuffled nor summed again when a batch meets them; only the additions, hashes
that more than one batch holds, are summed at the end.  When a level holds ``fanout`` runs they are merged into one of the next level, so a batch
meets few runs however many came before.  A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys are
compared by 128-bit hashes.

Very common lines: at most ``HOT`` hashes can hold a ``1 / HOT`` share of all lines; those are broadcast, so no key of a join has more than that share.

Nulls and ties: a null or empty text is one empty line; rows that share a ``doc_id`` are one document, rows without one are one document with the smallest, and
of rows that share the largest ``doc_id`` all keep the line.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.exchange import input_bytes
from quillon.llm.shared import drop_path, new_path, width, written

_SPACE = " \t\n\x0b\x0c\r"
_LOW = -(2**63)
RUN = "hi long, lo long, n_docs long, last_doc long"
HOT = 10_000


def _keys(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim(lines, characters=_SPACE))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_hashes(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """Distinct line keys of ``min_chars`` code points or more of each row: hi, lo, doc_id, batch."""

    def run(arrow: Iterator[pa.RecordBatch]):
        for batch in arrow:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, his, los = [], [], []
                lines = pc.split_pattern(part.column(1), "\n")
                keys = _keys(lines.flatten())
                long = pc.greater_equal(pc.utf8_length(keys), min_chars)
                owner = pc.list_parent_indices(lines).filter(long).to_pylist()
                doc_ids = part.column(0).to_pylist()
                seen: set = set()
                current = -1
                for o, key in zip(owner, keys.filter(long).to_pylist(), strict=True):
                    if o != current:
                        current, seen = o, set()
                    h = xxhash.xxh3_128_intdigest(key)
                    if h not in seen:
                        seen.add(h)
                        ids.append(doc_ids[o])
                        his.append(_signed(h >> 64))
                        los.append(_signed(h & 0xFFFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "hi long, lo long, doc_id long").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


class LineRuns:
    """The levelled store. Its runs are bucketed tables under the session's shared folder; ``drop`` removes them."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or width(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _save(self, rows: DataFrame) -> str:
        """A run: its own hashes (``known`` false) and its additions to earlier runs (``known`` true), as two partitions."""
        path = new_path(self.spark, "line-run")
        name = "quillon_" + path.rpartition("/")[2].replace("-", "_")
        rows = rows.select("hi", "lo", "n_docs", "last_doc", "known").repartition(self.buckets, "hi", "lo")
        rows.write.partitionBy("known").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self.paths.pop(name))

    def drop(self) -> None:
        for name in list(self.paths):
            self._drop(name)
        self.levels = []

    def _rows(self, name: str, known: bool) -> DataFrame:
        return self.spark.table(name).where(F.col("known") == known).select("hi", "lo", "n_docs", "last_doc")

    def runs(self) -> list[DataFrame]:
        """Disjoint by hash."""
        return [self._rows(name, False) for level in self.levels for name in level]

    def additions(self) -> DataFrame:
        """What later batches add to hashes of earlier ones, one row a hash."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], RUN)
        return _summed(reduce(DataFrame.unionByName, [self._rows(name, True) for name in names]))

    def merged(self) -> DataFrame:
        """One row a line hash over all runs."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], RUN)
        more = written(self.additions(), "line-additions")
        more = more.select("hi", "lo", F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
        n = (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs")
        last = F.greatest("last_doc", F.coalesce("later", "last_doc")).alias("last_doc")
        return reduce(DataFrame.unionByName, [r.join(more, ["hi", "lo"], "left").select("hi", "lo", n, last) for r in runs])

    def add(self, hashes: DataFrame) -> None:
        """A batch (hi, lo, doc_id) becomes a run; full levels are compacted."""
        batch = hashes.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("hi", "lo", F.lit(True).alias(f"in_{i}")).hint("merge"), ["hi", "lo"], "left")
            known = known | F.col(f"in_{i}").isNotNull()
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._save(batch.withColumn("known", known)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            own = reduce(DataFrame.unionByName, [self._rows(name, False) for name in names]).withColumn("known", F.lit(False))
            more = _summed(reduce(DataFrame.unionByName, [self._rows(name, True) for name in names])).withColumn("known", F.lit(True))
            whole = self._save(own.unionByName(more))
            for name in names:
                self._drop(name)
            self.levels[level] = []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(whole)
            level += 1


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 3, batch_bytes: int = 256 << 30) -> DataFrame:
    """Kept text of every row: doc_id, kept, n_lines, n_dropped.

    Lines whose key has ``min_chars`` code points and stands in ``min_docs`` documents or more go, except in the largest doc_id
    that holds it.  Documents arrive in ``batches`` by a hash of their id: by default as many as hold ``batch_bytes`` of files each, four at least.
    """
    spark = docs.sparkSession
    batches = batches or max(4, -(-input_bytes(docs) // batch_bytes))
    hashes = written(line_hashes(docs, min_chars, batches), "line-hashes", partition_by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(hashes.where(F.col("batch") == b).select("hi", "lo", "doc_id"))
    common = written(runs.merged().where(F.col("n_docs") >= min_docs), "common-lines")
    runs.drop()
    share = max(min_docs, hashes.count() // HOT)
    hot = common.where(F.col("n_docs") > share).select(F.col("hi").alias("hot_hi"), F.col("lo").alias("hot_lo"), F.col("last_doc").alias("hot_last"))
    cold = common.where(F.col("n_docs") <= share).select("hi", "lo", "last_doc")
    #: At most ``HOT`` rows: their documents are more than a HOT-th of all lines each.
    marked = hashes.select("hi", "lo", "doc_id").join(F.broadcast(hot), (F.col("hi") == F.col("hot_hi")) & (F.col("lo") == F.col("hot_lo")), "left")
    lost = marked.where("doc_id < hot_last").select("doc_id", "hi", "lo")
    lost = lost.unionByName(marked.where("hot_last is null").select("hi", "lo", "doc_id").join(cold, ["hi", "lo"]).where("doc_id < last_doc").select("doc_id", "hi", "lo"))
    lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("lost")).withColumnRenamed("doc_id", "lost_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.join(lost, F.coalesce(F.col("doc_id"), F.lit(_LOW)) == F.col("lost_id"), "left").select("doc_id", "text", "lost")

    def drop(arrow: Iterator[pa.RecordBatch]):
        for batch in arrow:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                kept, n_lines, n_dropped = [], [], []
                for text, gone in zip(part.column(1), part.column(2), strict=True):
                    text = text.as_py()
                    if not gone.is_valid:
                        kept.append(text)
                        n_lines.append(text.count("\n") + 1)
                        n_dropped.append(0)
                        continue
                    out = {(x["hi"], x["lo"]) for x in gone.as_py()}
                    lines = text.split("\n")
                    keys = _keys(pa.array(lines, pa.string()))
                    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_pylist()
                    stay = [x for x, is_long, key in zip(lines, long, keys.to_pylist(), strict=True) if not (is_long and _hash_pair(key) in out)]
                    kept.append("\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    ["doc_id", "kept", "n_lines", "n_dropped"],
                )

    return rows.mapInArrow(drop, "doc_id long, kept string, n_lines long, n_dropped long")


def _hash_pair(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


__all__ = ["LineRuns", "dedup_lines", "digest", "line_hashes"]
