"""Token-id output: ids of every document in bit or byte planes, compressed, with a chunk index.

Documents are dealt by ranges of ``doc_id`` and sorted within each range, so shards and the chunks in
them follow ``doc_id``.  A chunk holds whole documents; its ids are cut into fixed-size blocks, each block
is transposed into one plane a byte (or a bit) of an id, and each plane is compressed by itself.  Chunks are
rows of a Parquet table (binary payload and index columns), so Spark's commit protocol makes a lost or
repeated task harmless and any store that Spark can write will do.  ``index/`` holds one row a chunk with
the number of ids before it in the whole output.

Nulls and ties: a null or empty text has no ids but the end id; rows without ``doc_id`` come first; rows
that share a ``doc_id`` are each written, in an order that only depends on their texts.  An empty table
gives empty tables.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import new_path, small_batches, width
from quillon.llm.text import pack, release, unpack

_HEAD = struct.Struct("<4sBBHIQ")
_MAGIC = b"QBP1"

CHUNKS = "shard int, chunk int, first_doc long, last_doc long, n_docs long, n_ids long, shard_start long, payload_crc32 long, payload binary, docs binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_planes(ids: np.ndarray, block: int = 1 << 16, bits: bool = False, level: int = 3) -> bytes:
    """Unsigned 32-bit ids as a payload: a header, the compressed size of each plane of each block, the planes."""
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if len(ids) else 0
    n_bytes = max(1, (top.bit_length() + 7) // 8)
    planes = max(1, top.bit_length()) if bits else n_bytes
    z, sizes, parts = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block):
        raw = ids[at : at + block].view(np.uint8).reshape(-1, 4)
        if bits:
            cells = np.unpackbits(raw, axis=1, bitorder="little")[:, :planes]
            rows = [np.packbits(cells[:, k], bitorder="little").tobytes() for k in range(planes)]
        else:
            rows = [raw[:, k].tobytes() for k in range(planes)]
        for row in rows:
            parts.append(z.compress(row))
            sizes.append(len(parts[-1]))
    head = _HEAD.pack(_MAGIC, bits, planes, 0, block, len(ids))
    return head + np.array(sizes, "<u4").tobytes() + b"".join(parts)


def decode_planes(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; only the blocks that hold them are decompressed."""
    import zstandard

    magic, bits, planes, _, block, n = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a plane payload")
    stop = n if stop is None else min(stop, n)
    n_blocks = -(-n // block)
    sizes = np.frombuffer(payload, "<u4", n_blocks * planes, _HEAD.size).astype(np.int64)
    at = _HEAD.size + 4 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)])
    z, out = zstandard.ZstdDecompressor(), []
    first, last = start // block, -(-stop // block)
    for b in range(first, last):
        m = min(block, n - b * block)
        raw = np.zeros((m, 4), np.uint8)
        cells = np.zeros((m, 32), np.uint8) if bits else None
        for k in range(planes):
            i = b * planes + k
            plane = np.frombuffer(z.decompress(payload[at[i] : at[i + 1]]), np.uint8)
            if bits:
                cells[:, k] = np.unpackbits(plane, count=m, bitorder="little")
            else:
                raw[:, k] = plane
        out.append((np.packbits(cells, axis=1, bitorder="little") if bits else raw).view("<u4").ravel())
    ids = np.concatenate(out) if out else np.empty(0, "<u4")
    return ids[start - first * block : stop - first * block]


#: ASCII punctuation that no contraction begins with: at a piece's end, after a letter or digit, it is a token run of its own.
_TAIL = b".,;:!?|%$&*#)]}>=-_+~^/@\"\\"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r\x0b\x0c")] = True
#: Pieces of up to so many 8-byte words are looked up on arrays, longer ones in a dictionary.
_WORDS = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class _PieceTable:
    """Codes of short byte strings, by open addressing on arrays; a key is the string itself and its length, so no two share a code."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 12, -1, np.int32)
        self.keys, self.n = np.empty((1 << 10, _WORDS + 1), np.uint64), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys @ _ODD
            h = (h ^ (h >> np.uint64(31))) * _ODD[0]
        return ((h >> np.uint64(29)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, -1 for unknown ones."""
        out, slot, live = np.full(len(keys), -1, np.int64), self._home(keys), np.arange(len(keys))
        while len(live):
            code = self.slots[slot[live]]
            some = code >= 0
            live, code = live[some], code[some]
            same = (self.keys[code] == keys[live]).all(1)
            out[live[same]] = code[same]
            live = live[~same]
            slot[live] = (slot[live] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct unknown keys; their codes follow on."""
        n = self.n + len(keys)
        if n > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.n], np.empty((2 * n - self.n, _WORDS + 1), np.uint64)])
        self.keys[self.n : n] = keys
        first, self.n = self.n, n
        if 2 * n > len(self.slots):
            self.slots, first = np.full(1 << (4 * n).bit_length(), -1, np.int32), 0
        codes = np.arange(first, n)
        slot = self._home(self.keys[first:n])
        while len(codes):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = codes[free]  # of several that want a slot one stays
            lost = self.slots[slot] != codes
            codes, slot = codes[lost], (slot[lost] + 1) & (len(self.slots) - 1)


class PieceEncoder:
    """Encodes by white-space separated pieces, each distinct piece once.

    It fits tokenizers that treat such pieces independently (see ``splits_at_space``).  A new piece is taken apart further where that is certain to give the
    same ids: trailing punctuation after an ASCII letter or digit, and case where all is ASCII.  Beyond ``keep`` known pieces, or parts, all are forgotten and
    learned anew, which bounds the memory of a worker.
    """

    def __init__(self, tokenizer, keep: int = 1_000_000) -> None:
        self.tokenizer, self.keep = tokenizer, keep
        sep = tokenizer.encode("\x01", add_special_tokens=False).ids
        #: Parts are encoded many at once, divided by a control character, where that is one id.
        self.divider = sep[0] if len(sep) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.short, self.long = _PieceTable(), {}
        #: A short piece's code, or a long one's from the end, gives its two parts' codes; a part's code gives its ids in ``flat``. Part 0 is empty.
        self.pairs, self.long_pairs = np.empty((0, 2), np.int32), np.empty((0, 2), np.int32)
        self.parts: dict[bytes, int] = {b"": 0}
        self.flat, self.ends, self.n_ids = np.empty(0, np.uint32), np.zeros(2, np.int64), 0

    @staticmethod
    def split(piece: bytes) -> tuple[bytes, bytes]:
        if b"<|" in piece:
            return piece, b""
        core = piece.rstrip(_TAIL)
        tail = piece[len(core) :]
        if tail and (not core or core[-1] not in _ALNUM):
            core, tail = piece, b""
        return (core.lower() if core.isascii() else core), tail

    def _ids(self, parts: list[bytes], group: int = 200, at_once: int = 8000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and the number of each part's. The library's results, some hundred bytes an id, are held for ``at_once`` parts."""
        if len(parts) > at_once:
            some = [self._ids(parts[i : i + at_once], group, at_once) for i in range(0, len(parts), at_once)]
            return np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        alone = [self.divider is None or b"\x01" in p or b"<|" in p for p in parts]
        texts = [p.decode("utf-8", "replace") for p in parts]
        plain = [t for t, a in zip(texts, alone, strict=True) if not a]
        groups = [" \x01 ".join(plain[i : i + group]) for i in range(0, len(plain), group)]
        got = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(chain([self.divider], e.ids) for e in got), np.uint32) if groups else np.empty(0, np.uint32)
        cut = np.flatnonzero(ids == self.divider) if groups else np.empty(0, np.int64)
        lens = np.diff(np.append(cut, len(ids))) - 1
        ids = np.delete(ids, cut)
        if not any(alone):
            return ids, lens
        runs = iter(np.split(ids, np.cumsum(lens)[:-1]) if len(lens) else [])
        singles = iter(self.tokenizer.encode_batch_fast([t for t, a in zip(texts, alone, strict=True) if a], add_special_tokens=False))
        every = [np.array(next(singles).ids, np.uint32) if a else next(runs) for a in alone]
        return np.concatenate(every), np.array([len(x) for x in every], np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The codes of the two parts of each piece; new parts are encoded."""
        split = list(chain.from_iterable(map(self.split, pieces)))
        of = list(map(self.parts.get, split))
        fresh: list[bytes] = []
        for i, code in enumerate(of):
            if code is None:
                of[i] = code = self.parts.setdefault(split[i], len(self.parts))
                if code == len(self.ends) - 1 + len(fresh):
                    fresh.append(split[i])
        if fresh:
            ids, lens = self._ids(fresh)
            if self.n_ids + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.n_ids], np.empty(self.n_ids + 2 * len(ids), np.uint32)])
            self.flat[self.n_ids : self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        return np.array(of, np.int32).reshape(-1, 2)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text. The collector would walk the dictionaries again and again for the many small lists made here."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            if self.short.n + len(self.long) > self.keep or len(self.parts) > self.keep:
                self._clear()
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        lens = np.array([len(t) if t else 0 for t in texts], np.int64)
        raw = b" ".join([*(t or b"" for t in texts), b" " * (8 * _WORDS)])
        white = _WHITE[np.frombuffer(raw, np.uint8)]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        size = end - start
        at = np.flatnonzero(size <= 8 * _WORDS)
        words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        keys = np.empty((len(at), _WORDS + 1), np.uint64)
        for k in range(_WORDS):
            keys[:, k] = words[start[at] + 8 * k] & _MASKS[np.clip(size[at] - 8 * k, 0, 8)]
        keys[:, _WORDS] = size[at]
        code = self.short.find(keys)
        new = np.flatnonzero(code < 0)
        if len(new):
            met: dict[bytes, int] = {}
            place = at[new]
            got = [met.setdefault(raw[a:b], len(met)) for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)]
            got = np.fromiter(got, np.int64, len(got))
            code[new] = got + self.short.n
            first = np.empty(len(met), np.int64)
            first[got[::-1]] = new[::-1]
            self.pairs = np.concatenate([self.pairs, self._learn(list(met))])
            self.short.add(keys[first])
        pairs = np.empty((len(start), 2), np.int32)
        pairs[at] = self.pairs[code]
        del keys, code
        rest = np.flatnonzero(size > 8 * _WORDS)
        if len(rest):
            pieces = [raw[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            met = {p: None for p in pieces if p not in self.long}
            for p in met:
                self.long[p] = len(self.long)
            if met:
                self.long_pairs = np.concatenate([self.long_pairs, self._learn(list(met))])
            pairs[rest] = self.long_pairs[[self.long[p] for p in pieces]]
        c = pairs.ravel()
        begin = self.ends[c]
        n = self.ends[c + 1] - begin
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)]
        bound = np.concatenate([[0], np.cumsum(lens + 1)])
        cuts = total[2 * np.searchsorted(start, bound)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def splits_at_space(path: str) -> bool:
    """Whether a tokenizers file surely encodes pieces between ASCII white space independently, and upper-case ASCII as lower-case.

    True for a split that keeps only runs without white space, after context-free normalisers of which one lower-cases.
    """
    import json

    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    kinds = {n.get("type") for n in (t.get("normalizer") or {}).get("normalizers", [])}
    pre = (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = pre[0].get("pattern")
    return (
        kinds <= {"NFC", "Replace", "Lowercase"}
        and "Lowercase" in kinds
        and pre[0].get("type") == "Split"
        and pre[0].get("behavior") == "Removed"
        and bool(pre[0].get("invert"))
        and isinstance(pattern, dict)
        and pattern.get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and t.get("post_processor") is None
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or len(a["content"].split()) != 1 for a in t.get("added_tokens", []))
    )


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """A worker keeps its encoder between tasks."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if splits_at_space(path):
            _ENCODERS[path] = PieceEncoder(t).encode
        else:
            _ENCODERS[path] = lambda texts: [
                np.array(e.ids, np.uint32)
                for e in t.encode_batch_fast([(x or b"").decode("utf-8", "replace") for x in texts], add_special_tokens=False)
            ]
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    end_id: int = 1,
    chunk_ids: int = 1 << 18,
    block: int = 1 << 16,
    bits: bool = False,
    batch_bytes: int = 1 << 20,
) -> str:
    """Encodes ``docs`` (doc_id, text) to ``path`` (``chunks/`` and ``index/``) and returns it.

    A chunk closes with the document that brings it to ``chunk_ids`` ids.  Memory of a task: a batch of texts and a chunk.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")

    def chunks(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, doc_ids, lens, held, before, seq = [], [], [], 0, 0, 0
        end = np.array([end_id], np.uint32)

        def close():
            flat = np.concatenate(ids)
            payload = encode_planes(flat, block, bits)
            nulls = np.array([d is None for d in doc_ids], np.uint8)
            keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
            packed = [nulls.tobytes(), keys.tobytes(), pack(np.array(lens))]
            docs_blob = struct.pack("<I", len(doc_ids)) + b"".join(packed)
            row = [shard, seq, doc_ids[0], doc_ids[-1], len(doc_ids), len(flat), before, zlib.crc32(payload), payload, docs_blob]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.int64()] * 6 + [pa.binary()] * 2, strict=True)],
                ["shard", "chunk", "first_doc", "last_doc", "n_docs", "n_ids", "shard_start", "payload_crc32", "payload", "docs"],
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                n, stop = 0, at
                while stop < len(keys) and (n < batch_bytes or stop == at):
                    n += len(texts[stop].as_py() or b"")
                    stop += 1
                for key, got in zip(keys[at:stop], encode(texts.slice(at, stop - at).to_pylist()), strict=True):
                    ids += [got, end]
                    doc_ids.append(key)
                    lens.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= chunk_ids:
                        yield close()
                        before, seq = before + held, seq + 1
                        ids, doc_ids, lens, held = [], [], [], 0
                        release()
                at = stop
        if doc_ids:
            yield close()
        ids.clear()
        release()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .repartitionByRange(width(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    with small_batches(spark):
        ordered.mapInArrow(chunks, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    index = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").drop("payload", "docs")
    #: One row a shard, however large the input: the window holds no more rows than there were partitions.
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("of_shard"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    index.join(shards, F.col("shard") == F.col("of_shard")).select(
        *index.columns, (F.col("base") + F.col("shard_start")).alias("start")
    ).write.parquet(f"{path}/index")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and the crc32 of its little-endian 32-bit ids."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "payload_crc32", "payload", "docs")
    index = spark.read.parquet(f"{path}/index").select(F.col("shard").alias("s"), F.col("chunk").alias("c"), "start")
    rows = chunks.join(index, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, payload, blob, crc = (batch.column(k)[i].as_py() for k in range(4))
                if zlib.crc32(payload) != crc:
                    raise ValueError("a chunk's payload is damaged")
                (n,) = struct.unpack_from("<I", blob)
                nulls = np.frombuffer(blob, np.uint8, n, 4).astype(bool)
                keys = np.frombuffer(blob, "<i8", n, 4 + n)
                lens = unpack(blob[4 + 9 * n :])
                ids = decode_planes(payload)
                cuts = np.concatenate([[0], np.cumsum(lens)])
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=nulls), pa.array(cuts[:-1] + start), pa.array(lens), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.select("start", "payload", "docs", "payload_crc32").mapInArrow(documents, RESULT)
