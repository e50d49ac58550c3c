"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training rows are quantised to levels, level = 1 + floor(log_base(count)), and a gram of level
q is put into a Bloom filter q times, once a level.  A count is read by probing level 1, 2, ... until one is missing; false hits only
raise it, each further level with a probability smaller by the filter's error rate.  The filter is cut into slices by the hash of a gram; a shard
of the counting exchange (see ``exchange``) builds its own slice, so no gram ever reaches the driver.  Slices are sized for
``bits_per_level`` bits an entry whatever the corpus, so the error rate does not grow with it, and they never leave their shard: a chunk sends all
its words and word pairs, also those of rows not to learn from, and the shard answers with the levels that its slice gives them.

P(w | u) = (c(u w) + mu * P(w)) / (c(u) + mu),  P(w) = (c(w) + 1) / (N + V + 1), with counts c from the filter; a level stands for the mean of the corpus's
counts in it.  c(u w) is never taken as more than c(u) or c(w), as only a false hit can say so.  P(w) adds up to 1 over the known words and one unknown.  The
pair counts of a context add up to its count on average but, being quantised, not in each context, so P(w | u) adds up to 1 only about.

Exact word counts for the add-one baseline come with the same answers.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and every text ends with one end token. A null or empty text is its end token; rows may
repeat; ``train`` marks training rows (null: not). Without training rows N and V are 0. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.exchange import ROW, shard_cuts, shards_for, summed
from quillon.llm.shared import written
from quillon.llm.text import WordCoder, in_chunks, mix, pack, pack_sorted, release, unpack, unpack_sorted, words

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_KEY = np.uint64(16)
RESULT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """48-bit keys of word pairs."""
    with np.errstate(over="ignore"):
        return mix(a * _MUL + b, 2) >> _KEY


class LogFrequencyFilter:
    """Slices of a Bloom filter by the top bits of 48-bit keys."""

    def __init__(self, slices: bytes, lengths: list[int], hashes: int, base: float) -> None:
        """``slices`` one after the other, used in place."""
        self.hashes, self.base = hashes, base
        self.edges = np.array([(i << 48) // len(lengths) for i in range(1, len(lengths))], np.uint64)
        sizes = np.array(lengths, np.uint64) * np.uint64(8)
        self.sizes, self.bases = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
        self.bits = np.frombuffer(slices, np.uint8)
        self.value = level_values(base)

    @staticmethod
    def level(counts: np.ndarray, base: float) -> np.ndarray:
        return (1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9)).astype(np.int64)

    @staticmethod
    def probes(keys: np.ndarray, order: int, level: int, i: int) -> np.ndarray:
        return mix(keys, (order << 20) | (level << 4) | i)

    @classmethod
    def slice_of(cls, grams: list[tuple[int, np.ndarray, np.ndarray]], hashes: int, base: float, bits_per_level: float, max_bytes: int | None = None) -> bytes:
        """The slice that holds (order, keys, counts), of ``bits_per_level`` bits an entry unless ``max_bytes`` is less."""
        levels = [(order, keys, cls.level(counts, base)) for order, keys, counts in grams]
        entries = sum(int(q.sum()) for _, _, q in levels)
        n_bytes = max(8, math.ceil(entries * bits_per_level / 8))
        if max_bytes is not None:
            n_bytes = min(max_bytes, n_bytes)
        bits = np.zeros(n_bytes * 8, bool)
        m = np.uint64(n_bytes * 8)
        for order, keys, q in levels:
            for level in range(1, int(q.max()) + 1 if len(q) else 1):
                keys, q = keys[q >= level], q[q >= level]
                for i in range(hashes):
                    bits[cls.probes(keys, order, level, i) % m] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def counts(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Estimated counts: the middle of the level."""
        return self.value[self.levels(keys, order)]

    def levels(self, keys: np.ndarray, order: int, block: int = 1 << 18) -> np.ndarray:
        """The highest level up to which all probes hit. Keys are probed in blocks."""
        if len(keys) > block:
            return np.concatenate([self.levels(keys[a : a + block], order) for a in range(0, len(keys), block)])
        shard = np.searchsorted(self.edges, keys, "right")
        size, base = self.sizes[shard], self.bases[shard]
        level, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, 65):
            live = at
            for i in range(self.hashes):
                if not len(live):
                    break
                bit = base[live] + self.probes(keys[live], order, q, i) % size[live]
                live = live[(self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            level[live] = q
            at = live
        return level


def _middle(level: int, base: float) -> float:
    """Mean of the whole counts of a level, or the range's geometric mean where there is none."""
    low, high = math.ceil(base ** (level - 1) - 1e-9), math.ceil(base**level - 1e-9) - 1
    return (low + high) / 2 if high >= low else base ** (level - 0.5)


def level_values(base: float) -> np.ndarray:
    """The count that each level stands for."""
    return np.array([0.0] + [_middle(j, base) for j in range(1, 65)])


def _chunks(chunk_bytes: int, shards: int):
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for ids, texts, train in in_chunks(batches, chunk_bytes):
            coder = WordCoder()
            coder.encode([b" end"])  # code 0; no word holds a space
            codes, lens = [], []
            for t in texts:
                c = coder.encode(words(t))
                codes += [c, np.zeros(1, np.int64)]
                lens.append(len(c) + 1)
            h = coder.hashes().copy()
            h[0] = END
            order = np.argsort(h, kind="stable")
            place = np.empty(len(h), np.int64)
            place[order] = np.arange(len(h))
            flat, lens = place[np.concatenate(codes)], np.array(lens)
            h = h[order]
            chunk, seq = (task << 24) | seq, seq + 1
            is_train = np.array([bool(x) for x in train])
            nulls = np.array([d is None for d in ids], np.uint8)
            keys = np.array([0 if d is None else d for d in ids], np.int64)
            meta = np.int64(len(ids)).tobytes() + nulls.tobytes() + is_train.astype(np.uint8).tobytes() + keys.tobytes() + pack(lens)
            out = [(chunk, chunk % shards, 0, meta, pack(flat))]
            counted = np.repeat(is_train, lens)
            counts = np.bincount(flat[counted], minlength=len(h))
            cuts = shard_cuts(h, 64, shards)
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    out.append((chunk, s, 1, pack(counts[a:b]), pack_sorted(h[a:b])))
            tokens = h[flat]
            before = np.concatenate([[START], tokens[:-1]])
            before[np.concatenate([[0], np.cumsum(lens)[:-1]])] = START
            pairs, inverse = np.unique(_pair(before, tokens), return_inverse=True)
            n = np.bincount(inverse[counted], minlength=len(pairs))
            cuts = shard_cuts(pairs, 48, shards)
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if b > a:
                    out.append((chunk, s, 2, pack(n[a:b]), pack_sorted(pairs[a:b])))
            del coder, codes, tokens, before, pairs, inverse, n, flat, h
            for at in range(0, len(out), 64):
                yield _rows(out[at : at + 64])
            del out
            release()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "shard", "kind", "head", "body"])


def _shard(hashes: int, base: float, bits_per_level: float):
    """A shard's slice of the filter, asked at once: to each chunk the counts and levels of its words and the levels of its pairs."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "shard", "kind", "head", "body")), strict=True))
        del table
        shard = rows[0][1]
        out = [r for r in rows if r[2] == 0]
        uni, two = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 2]
        del rows
        h, c = summed([(unpack_sorted(r[4]), unpack(r[3])) for r in uni])
        keys, n = summed([(unpack_sorted(r[4]), unpack(r[3])) for r in two])
        known, met = c > 0, n > 0
        sums = [np.bincount(LogFrequencyFilter.level(x, base), x, 65) for x in (c[known], n[met])]
        sizes = [np.bincount(LogFrequencyFilter.level(x, base), minlength=65) for x in (c[known], n[met])]
        out.append((-1, shard, 4, np.concatenate([[c.sum(), known.sum()], *sums, *sizes]).astype(np.int64).tobytes(), b""))
        part = LogFrequencyFilter.slice_of([(1, h[known] >> _KEY, c[known]), (2, keys[met], n[met])], hashes, base, bits_per_level)
        filt = LogFrequencyFilter(part, [len(part)], hashes, base)
        del n, known, met
        level = filt.levels(h >> _KEY, 1)
        for r in uni:
            at = np.searchsorted(h, unpack_sorted(r[4]))
            counts = pack(c[at])
            out.append((r[0], shard, 3, r[4], len(counts).to_bytes(4, "little") + counts + pack(level[at])))
        level = filt.levels(keys, 2).astype(np.uint8)
        for r in two:
            out.append((r[0], shard, 5, b"", pack(level[np.searchsorted(keys, unpack_sorted(r[4]))])))
        del uni, two, h, c, keys, level, filt, part
        release()
        return pa.Table.from_batches([_rows(out)])

    return run


def _added(batches):
    """The sum of all heads of a partition."""
    held = None
    for batch in batches:
        for head in batch.column(0):
            x = np.frombuffer(head.as_py(), np.int64)
            held = x if held is None else held + x
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["head"])


def score_documents(
    docs: DataFrame,
    train,
    chunk_bytes: int = 3 << 20,
    hashes: int = 4,
    base: float = 1.5,
    bits_per_level: float = 6.0,
    mu: float = 16.0,
) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); ``train`` is a boolean column of it that marks the rows to learn from."""
    shards = shards_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    sent = rows.mapInArrow(_chunks(chunk_bytes, shards), ROW)
    table = written(sent.groupBy("shard").applyInArrow(_shard(hashes, base, bits_per_level), ROW), "lm-counts")
    found = sum((np.frombuffer(r.head, np.int64) for r in table.where("kind = 4").select("head").mapInArrow(_added, "head binary").collect()), np.zeros(2 + 4 * 65, np.int64))
    total, distinct = int(found[0]), int(found[1])
    sums, sizes = found[2:132].reshape(2, 65), found[132:].reshape(2, 65)
    #: A level stands for the mean of the counts that it holds, so what the filter answers adds up to the training tokens.
    value, pair_value = (np.where(n > 0, s / np.maximum(n, 1), level_values(base)) for s, n in zip(sums, sizes, strict=True))

    def score(part: pa.Table) -> pa.Table:
        rows = list(zip(*(part.column(c).to_pylist() for c in ("shard", "kind", "head", "body")), strict=True))
        del part
        meta, body = next((r[2], r[3]) for r in rows if r[1] == 0)
        n = int(np.frombuffer(meta, np.int64, 1)[0])
        nulls, is_train = np.frombuffer(meta, np.uint8, n, 8).astype(bool), np.frombuffer(meta, np.uint8, n, 8 + n).astype(bool)
        ids = np.frombuffer(meta[8 + 2 * n : 8 + 10 * n], np.int64)
        lens, flat = unpack(meta[8 + 10 * n :]), unpack(body).astype(np.int32)
        answers, levels = sorted(r for r in rows if r[1] == 3), sorted(r for r in rows if r[1] == 5)
        del rows, body
        hashes_of = np.concatenate([unpack_sorted(r[2]) for r in answers])
        cut = [int.from_bytes(r[3][:4], "little") + 4 for r in answers]
        counts = np.concatenate([unpack(r[3][4:k]) for r, k in zip(answers, cut, strict=True)])
        single = value[np.concatenate([unpack(r[3][k:]) for r, k in zip(answers, cut, strict=True)])]
        both = pair_value[np.concatenate([unpack(r[3]) for r in levels])]
        del answers, levels
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        #: Everything that depends on a word alone is worked out once a word of the chunk.
        base_log = np.add.reduceat(np.log10((counts + 1) / (total + distinct + 1.0))[flat], starts)
        known = np.add.reduceat((counts > 0)[flat].astype(np.int64), starts)
        end_count = single[np.searchsorted(hashes_of, END)]
        tokens = hashes_of[flat]
        before = np.concatenate([[START], tokens[:-1]])
        before[starts] = START
        #: Shards answer for ranges of ascending pairs, so their answers follow each other as the chunk's distinct pairs do.
        both = both[np.unique(_pair(before, tokens), return_inverse=True)[1]]
        del tokens, before
        own = single[flat]
        context = np.concatenate([[0.0], own[:-1]])
        context[starts] = end_count  # as many texts begin as end
        logs = np.log10((np.minimum(both, np.minimum(context, own)) + mu * (own + 1) / (total + distinct + 1.0)) / (context + mu))
        logs = np.add.reduceat(logs, starts)
        del both, own, context, counts, hashes_of, single, flat
        release()
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=nulls), "train": pa.array(is_train), "n_tokens": pa.array(lens), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(base_log), "score": pa.array(logs),
            }
        )

    #: A chunk's words come back from the shards as counts and levels, in the order of shards; the words themselves come with them.
    return table.where("kind in (0, 3, 5)").groupBy("chunk").applyInArrow(score, RESULT)
