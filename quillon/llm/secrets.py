"""Incremental secret scan over a ledger of content-addressed blobs.

Native: DataFrame functions only.  A history has one row a version of a path: (path, version, text).  Texts are addressed by their
SHA-256.  ``scan`` drops the (blob, rule version) pairs that the ledger already holds, scans one copy of each blob that is left with the rules
it lacks, and appends spans to the ledger; ``report`` joins the spans back to every path and version.  Offsets are code points, end
exclusive: the pieces between matches (``split``) and the matches alternate, so their lengths add up to positions.

Nulls and ties: a null text is the empty blob; null paths and versions are values like any other.  Repeated rows are reported each; of the rows that
hold a blob the one with the least path and version is scanned.  Very long texts are scanned whole.  Spans that begin together are ordered by rule.  The
empty table gives an empty report; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.shared import new_path

SCAN = "blob string, rules array<string>, spans array<struct<start: int, rank: int, kind: string, stop: int>>"


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in Java's syntax; a match counts if ``group`` of it has ``least`` characters or more. A changed rule needs another version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of one class are maximal, so a least length inside the pattern finds what a filter afterwards would.
BASE = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
)


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """array<struct<start, rank, kind, stop>> of one rule's matches; a text without any costs one pass."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, stop: int>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len"), b.alias("match")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["len"]
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        ok = F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)
        return F.struct(stop.alias("at"), F.when(ok, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def history_of(documents: DataFrame, path: str = "doc_id", text: str = "text", version: str | None = None) -> DataFrame:
    return documents.select(
        F.col(path).alias("path"), (F.col(version) if version else F.lit(0)).alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


class SecretLedger:
    """Blobs scanned so far, by rule version, under ``root``. A ledger on a root that holds finished scans goes on from them; a scan that broke off counts as none."""

    def __init__(self, spark: SparkSession, root: str | None = None, rules: tuple[SecretRule, ...] = BASE + MORE) -> None:
        self.spark, self.root, self.rules = spark, root or new_path(spark, "secret-ledger"), rules
        self._parts = self._finished()

    def _finished(self) -> list[str]:
        """Folders of scans that Spark has marked as complete."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        paths = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("scan-")]
        return sorted(p.toString() for p in paths if fs.exists(hadoop(p, "_SUCCESS")))

    def _scans(self) -> DataFrame:
        if not self._parts:
            return self.spark.createDataFrame([], SCAN)
        return self.spark.read.schema(SCAN).parquet(*self._parts)

    def reopen(self, parts: list[str]) -> SecretLedger:
        """Continues with batches that an earlier ledger wrote (``parts``)."""
        self._parts = list(parts)
        return self

    @property
    def parts(self) -> list[str]:
        return list(self._parts)

    def scan(self, history: DataFrame) -> None:
        """Scans the unseen (blob, rule version) pairs of a history (see ``history_of``)."""
        #: One copy a blob, without its text: the hottest blob is one row a task.
        blobs = history.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
        wanted = F.array(*[F.lit(r.id) for r in self.rules])
        if self._parts:
            held = self._scans().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("held"))
            blobs = blobs.join(held, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("held", F.array().cast("array<string>")))).drop("held")
        else:
            blobs = blobs.withColumn("todo", wanted)
        todo = blobs.where(F.size("todo") > 0).select(F.col("blob").alias("todo_blob"), "at.path", "at.version", "todo")
        todo = todo.withColumnsRenamed({"path": "todo_path", "version": "todo_version"})
        #: The path is (nearly) unique, so this join moves each text once and has no hot key.
        same = F.col("path").eqNullSafe(F.col("todo_path")) & F.col("version").eqNullSafe(F.col("todo_version")) & (F.col("blob") == F.col("todo_blob"))
        texts = history.join(todo, same).select("blob", "text", "todo")
        spans = F.array_sort(F.concat(*[F.when(F.array_contains("todo", r.id), spans_of(F.col("text"), r, k)).otherwise(F.array().cast("array<struct<start: int, rank: int, kind: string, stop: int>>")) for k, r in enumerate(self.rules)]))
        part = f"{self.root}/scan-{len(self._parts):06d}-{uuid.uuid4().hex}"
        texts.select("blob", F.col("todo").alias("rules"), spans.alias("spans")).write.parquet(part)
        self._parts.append(part)

    def report(self, history: DataFrame) -> DataFrame:
        """Every row of the history with the spans of its blob by this ledger's rules: path, version, blob, spans."""
        kinds = F.array(*[F.lit(r.kind) for r in self.rules])
        #: A blob can stand in several scans (new rules) or twice in one (a repeated row): its spans are put together once.
        found = self._scans().where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
        found = found.select(F.col("blob").alias("found_blob"), F.array_sort(F.array_distinct(F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])))).alias("spans"))
        out = history.select("path", "version", "blob").join(found, F.col("blob") == F.col("found_blob"), "left")
        return out.select("path", "version", "blob", F.coalesce("spans", F.array().cast("array<struct<start: int, rank: int, kind: string, stop: int>>")).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))))
