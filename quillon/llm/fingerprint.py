"""Bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's word shingles, ascending.  Sketches of parts merge
into the sketch of the whole (``merge``); two of them estimate resemblance, containment and, one alone, the number of
distinct shingles.  Below k shingles all of these are exact.

Texts of 1 to n-1 words have their whole word sequence as one shingle.  A null, empty or blank text has an empty
sketch; two empty sketches are alike (1.0), an empty and another are not (0.0).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import width
from quillon.llm.text import WordCoder, shingles, words

BITS = 48
_SHIFT = np.uint64(64 - BITS)


def sketch_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values of 64-bit shingle hashes, cut to 48 bits."""
    h = hashes >> _SHIFT
    if len(h) > 4 * k:
        low = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard estimate: the share of the union's k smallest values that both sketches hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~same])][:k]
    return float(np.count_nonzero(both[1:][same] <= union[-1])) / len(union)


def distinct_estimate(a: np.ndarray, k: int) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * float(2**BITS) / float(a[-1] + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    if len(a) < k and len(b) < k:
        return len(np.intersect1d(a, b)) / len(a)
    j = resemblance(a, b, k)
    shared = j * distinct_estimate(merge(a, b, k), k)
    return min(1.0, shared / distinct_estimate(a, k))


def to_text(a: np.ndarray) -> str:
    """Six little-endian bytes a value, in base64."""
    return base64.b64encode(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.hstack([raw, np.zeros((len(raw), 2), np.uint8)]).view("<u8").ravel()


def fingerprint_documents(docs: DataFrame, k: int = 128, n: int = 5) -> DataFrame:
    """Sketch of every row: adds ``fingerprint`` and ``distinct_shingles`` (estimate) to doc_id. No shuffle."""

    def run(batches):
        coder = WordCoder()
        for batch in batches:
            out = []
            for text in batch.column(1):
                coder.renew()
                out.append(sketch_of(shingles(coder.hashed(words(text.as_py())), n), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(s) for s in out], pa.string()), pa.array([distinct_estimate(s, k) for s in out], pa.float64())],
                ["doc_id", "fingerprint", "distinct_shingles"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string, distinct_shingles double"
    )


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor(docs: DataFrame, k: int = 128, n: int = 5, ranges: int | None = None) -> DataFrame:
    """Each document beside the one that follows it by ``doc_id`` (after the last: the first).

    The edited text is the document with its last quarter of code points replaced by the start of its successor.
    Documents are dealt by ranges of ``doc_id`` whose bounds are ids in the table, and sorted, so a successor is the next
    row; a document on a bound is sent to the range before it too, as the successor of that range's last.  The driver holds
    the bounds, ``ranges`` numbers (three a shuffle partition unless given).  Rows without doc_id come first; rows that share
    one are ordered by text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = ranges or 3 * width(spark)
    low = -(2**63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    at = [i / ranges for i in range(ranges)]
    first, cuts = rows.agg(F.min("key"), F.percentile_approx("key", at, 20 * ranges)).first()
    bounds = sorted({first, *cuts}) if cuts else []
    if not bounds:
        return spark.createDataFrame([], _FIELDS)
    table = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        """Twice the place of the last bound not above a key, and one more if the key is that bound."""
        at = np.searchsorted(table, key.to_numpy(), "right") - 1
        return pd.Series(2 * at + (table[at] == key.to_numpy()))

    own = F.shiftright("place", 1).cast("int")
    guest = F.when(F.col("place") % 2 == 1, F.pmod(own - 1, F.lit(len(bounds))))
    dealt = (
        rows.withColumn("place", place("key"))
        .withColumn("to", F.explode(F.filter(F.array(F.struct(own.alias("part"), F.lit(False).alias("guest")), F.struct(guest.alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"].isNotNull())))
        .select("to.part", "to.guest", "key", "doc_id", "text")
        .repartition(width(spark), "part")
        .sortWithinPartitions("part", "guest", "key", "text")
    )

    def run(batches):
        pairs = _Pairs(k, n)
        last, served = None, None
        for batch in batches:
            out = []
            texts = batch.column(3)
            for i, (part, is_guest, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                text = texts[i].as_py()
                if last is not None and last[0] == part and served != part:
                    out.append(pairs.result(last[1], last[2], text))
                    if len(out) >= 512:
                        yield _batch(out)
                        out = []
                if is_guest:
                    served = part
                last = (part, key, text)
            if out:
                yield _batch(out)

    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(run, _FIELDS)


class _Pairs:
    """Results of documents and their successors; a successor's sketch is kept for its own turn."""

    def __init__(self, k: int, n: int) -> None:
        self.k, self.n, self.coder, self.seen = k, n, WordCoder(), (None, None)

    def sketch(self, text: str) -> np.ndarray:
        return sketch_of(shingles(self.coder.hashed(words(text.encode())), self.n), self.k)

    def result(self, key, text: str, after: str) -> tuple:
        self.coder.renew()
        own = self.seen[1] if self.seen[0] is text else self.sketch(text)
        following = self.sketch(after)
        self.seen = (after, following)
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        changed = own if edited == text else self.sketch(edited)
        return (
            key, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(changed),
            resemblance(own, changed, self.k), resemblance(own, following, self.k),
        )


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
