"""Counts over all documents for what is in a chunk of them.

A chunk (some MB of texts handled by one task) sends its sorted hashes to shards by their top bits, packed; a shard holds all hashes of
its range, counts them over all chunks, and answers.  Nothing is exploded into rows, and a hash that a third of all documents hold is one
value in each chunk's blob.  The number of shards follows the input's size, so a shard holds as much however large the corpus is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillon.llm.shared import width

ROW = "chunk long, shard int, kind int, head binary, body binary"


def shard_cuts(sorted_hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's range begins in ascending hashes of ``bits`` bits, and the end."""
    edges = [(i * (1 << bits)) // shards for i in range(1, shards)]
    inner = np.searchsorted(sorted_hashes, np.array(edges, np.uint64)) if edges else np.empty(0, np.int64)
    return np.concatenate([[0], inner, [len(sorted_hashes)]]).astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and summed counts of several (hashes, counts)."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def shards_for(docs: DataFrame, shard_bytes: int = 64 << 20) -> int:
    """Shards of about ``shard_bytes`` of the input's files, and no fewer than the session's shuffle partitions."""
    return max(width(docs.sparkSession), input_bytes(docs) // shard_bytes)


def input_bytes(docs: DataFrame) -> int:
    """Bytes of the files that ``docs`` reads; relations of unknown size count as nothing."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 62)
