"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so their Jaccard similarity is tiny and signatures of both sides rarely agree.
The search is therefore one-sided: an item is represented by the ``k`` shingles with the smallest hashes (its bottom-k
MinHash sketch), and each of them is looked up among *all* shingles of a document; the share found is an unbiased estimate of
the item's containment.  Items are partitioned by size; each size class has its own sketch length, its own index and, for each
size, the least number of hits that a document must have, chosen so that an item of containment ``threshold`` is missed with a probability under
``miss``.  Items with no more shingles than their class's sketch are represented whole, and lose nothing.  Every candidate
(document, item) is verified by exact containment over whole texts.

The sketches of a block of items travel with the job; ``block_items`` bounds a block, and more items mean more blocks, each one
pass over the documents.  The documents are never shuffled.

Words ignore case and ASCII punctuation.  An item with fewer than ``n`` words has no shingle; its whole word sequence is looked up among the document's
sequences of that length (one exact table a length), and counts as one shingle.  An item without words is never found; a
null or empty text holds nothing; repeated items and repeated documents each count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.text import WordCoder, plain_words, release, shingles

MATCH = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def needed(size: int, threshold: float) -> int:
    """The least whole number of shingles that is ``threshold`` of ``size``, with the threshold taken as the decimal it is written as."""
    t = Fraction(str(threshold))
    return -(-size * t.numerator // t.denominator)


def least_hits(size: int, sketch: int, threshold: float, miss: float) -> int:
    """The most hits one may ask for of a sketch so that an item of ``threshold`` containment passes with 1 - ``miss``.

    The shingles found are drawn without replacement, so hits are hypergeometric.
    """
    held = needed(size, threshold)
    if sketch >= size:
        return held
    below, total = 0.0, comb(size, sketch)
    for h in range(sketch + 1):
        below += comb(held, h) * comb(size - held, sketch - h) / total if h <= held and sketch - h <= size - held else 0.0
        if below > miss:
            return max(1, h)
    return max(1, sketch)


def _table(hashes: list, owners: list) -> tuple[np.ndarray, np.ndarray]:
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    return h[order], o[order]


def _hits(table: np.ndarray, owner: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray:
    """How many of ``seen`` (distinct) each owner holds."""
    a, b = np.searchsorted(table, seen, "left"), np.searchsorted(table, seen, "right")
    lens = b - a
    at = np.repeat(a - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum()) if len(lens) else a
    return np.bincount(owner[at], minlength=n)


class SizePartition:
    """The items of 2^c to 2^(c+1)-1 shingles: their MinHash sketches, all of one length, the hits that each item needs, and the whole sets."""

    def __init__(self, items: list[tuple[int, np.ndarray]], sketch: int, threshold: float, miss: float) -> None:
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(s) for _, s in items], np.int64)
        #: Longer items have longer sketches, so that one more hit is asked for and fewer documents are candidates.
        self.length = sketch + 4 * max(0, int(self.sizes[0]).bit_length() - 6)
        lengths = np.minimum(self.sizes, self.length)
        self.need = np.array([least_hits(int(m), int(k), threshold, miss) for m, k in zip(self.sizes, lengths, strict=True)], np.int64)
        self.enough = np.array([needed(int(m), threshold) for m in self.sizes], np.int64)
        numbers = np.arange(len(items))
        self.sketch, self.sketch_owner = _table([s[:k] for (_, s), k in zip(items, lengths, strict=True)], [np.full(k, i) for i, k in zip(numbers, lengths, strict=True)])
        self.whole, self.whole_owner = _table([s for _, s in items], [np.full(len(s), i) for i, (_, s) in zip(numbers, items, strict=True)])

    def candidates(self, near: np.ndarray) -> np.ndarray:
        """Items of which a document's shingles hold enough of the sketch."""
        return np.flatnonzero(_hits(self.sketch, self.sketch_owner, near, len(self.ids)) >= self.need)

    def verified(self, found: np.ndarray, whole: np.ndarray) -> list[tuple[int, int, int]]:
        shared = _hits(self.whole, self.whole_owner, whole[np.isin(whole, self.whole)], len(self.ids))
        return [(self.ids[c], int(shared[c]), int(self.sizes[c])) for c in found if shared[c] >= self.enough[c]]


class ItemIndex:
    """A block of items: one partition a size class, and exact tables for items without shingles."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, threshold: float, sketch: int, miss: float) -> None:
        self.n = n
        coder = WordCoder()
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        shorter: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            w = plain_words(text)
            if len(w) >= n:
                s = np.unique(shingles(coder.hashed(w), n))
                classes.setdefault(len(s).bit_length(), []).append((item_id, s))
            elif w:
                shorter.setdefault(len(w), {}).setdefault(int(shingles(coder.hashed(w), len(w))[0]), []).append(item_id)
        self.short = [(length, np.array(sorted(ids), np.uint64), ids) for length, ids in sorted(shorter.items())]
        self.partitions = [SizePartition(of, sketch, threshold, miss) for _, of in sorted(classes.items())]
        #: What no partition's sketches can hold is left out by one look.
        self.bloom = np.zeros(1 << 21, bool)
        for p in self.partitions:
            self.bloom[p.sketch >> np.uint64(43)] = True

    def matches(self, doc_shingles: np.ndarray) -> list[tuple[int, int, int]]:
        """(item_id, shared, size) of the items that a document holds."""
        near = doc_shingles[self.bloom[doc_shingles >> np.uint64(43)]]
        if not len(near):
            return []
        near, whole, out = np.unique(near), None, []
        for p in self.partitions:
            found = p.candidates(near)
            if len(found):
                whole = np.unique(doc_shingles) if whole is None else whole
                out += p.verified(found, whole)
        return out

    def found(self, hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """``matches`` of a document's word hashes, and the items of fewer than ``n`` words that it holds."""
        out = self.matches(shingles(hashed, self.n)) if len(hashed) >= self.n else []
        for length, keys, ids in self.short:
            if len(hashed) >= length:
                out += [(i, 1, 1) for h in np.intersect1d(shingles(hashed, length), keys) for i in ids[int(h)]]
        return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, bytes]]]:
    """The stated query set in blocks of at most ``block_items``; the driver holds one block at a time."""
    held: list = []
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator():
        held.append((row[0], bytes(row[1] or b"")))
        if len(held) == block_items:
            yield held
            held = []
    if held:
        yield held


def _indexes(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float, sketch: int, miss: float, block_items: int) -> list:
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(ItemIndex(b, n, threshold, sketch, miss)) for b in _blocks(benchmark, block_items)]


def find_contained(
    docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, sketch: int = 16, miss: float = 1e-6, block_items: int = 20_000
) -> DataFrame:
    """One row for each (document, item) with at least ``threshold`` of the item's n-word shingles (an item of fewer words: all of it) in the document."""
    indexes = _indexes(docs, benchmark, n, threshold, sketch, miss, block_items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if not indexes:
        return docs.sparkSession.createDataFrame([], MATCH)

    def search(index):
        def run(batches):
            coder, table = WordCoder(), index.value
            for batch in batches:
                out = []
                keys = batch.column(0).to_pylist()
                for key, text in zip(keys, batch.column(1), strict=True):
                    coder.renew()
                    w = plain_words(text.as_py())
                    if w:
                        out += [(key, i, s, m, s / m) for i, s, m in table.found(coder.hashed(w))]
                if out:
                    types = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                        ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )
            del coder
            release()

        return run

    return reduce(DataFrame.unionByName, [rows.mapInArrow(search(i), MATCH) for i in indexes])


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, sketch: int = 16, miss: float = 1e-6, block_items: int = 20_000
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for index in _indexes(docs, benchmark, n, threshold, sketch, miss, block_items):

        def run(batches, index=index):
            coder, table = WordCoder(), index.value
            for batch in batches:
                keep = []
                for text in batch.column("text").cast(pa.binary()):
                    coder.renew()
                    w = plain_words(text.as_py())
                    keep.append(not w or not table.found(coder.hashed(w)))
                yield batch.filter(pa.array(keep, pa.bool_()))
            del coder
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
