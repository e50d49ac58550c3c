"""Words, shingles and hashes on numpy arrays, used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of a 64-bit polynomial hash and a finalising mixer.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A-Z to a-z and ASCII punctuation to a space, for comparisons that ignore both.
_PLAIN = bytes(
    32 if (chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") else i + 32 if 65 <= i <= 90 else i for i in range(256)
)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of uint64 values, another for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes with A-Z lower-cased; bytes methods touch ASCII only."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words with Unicode lower case and without ASCII punctuation."""
    if not text:
        return []
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_PLAIN).split()


class _Codes(dict):
    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordCoder:
    """Gives words dense codes and keeps one 64-bit hash a code.

    ``reset_at`` bounds its memory: ``renew`` starts afresh beyond that many distinct words.
    """

    def __init__(self, reset_at: int = 400_000) -> None:
        self.reset_at = reset_at
        self._clear()

    def _clear(self) -> None:
        self.codes, self._room, self._n = _Codes(), np.empty(0, np.uint64), 0

    def renew(self) -> None:
        if len(self.codes) > self.reset_at:
            self._clear()

    def encode(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))

    def hashes(self) -> np.ndarray:
        """Hash of each code; room grows by doubling, so many small calls stay cheap."""
        fresh = self.codes.fresh
        if fresh:
            new = np.array([xxhash.xxh3_64_intdigest(w) for w in fresh], np.uint64)
            n = self._n + len(new)
            if n > len(self._room):
                self._room = np.concatenate([self._room[: self._n], np.empty(max(n, 1024), np.uint64)])
            self._room[self._n : n] = new
            self._n, self.codes.fresh = n, []
        return self._room[: self._n]

    def hashed(self, tokens: list[bytes]) -> np.ndarray:
        codes = self.encode(tokens)
        return self.hashes()[codes]


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; of the whole sequence if it has 1 to n-1 words."""
    m = len(word_hashes)
    if m == 0:
        return np.empty(0, np.uint64)
    k = min(n, m)
    with np.errstate(over="ignore"):
        acc = word_hashes[: m - k + 1].copy()
        for i in range(1, k):
            acc = acc * _MUL + word_hashes[i : m - k + 1 + i]
    return mix(acc, k)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstandard-compressed byte planes of their differences."""
    import zstandard

    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any integers as zstandard-compressed byte planes, narrow ones in fewer."""
    import zstandard

    top = int(values.max()) if len(values) else 0
    w = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = np.ascontiguousarray(values.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T).tobytes()
    return bytes([w]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    w = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(w, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{w}").ravel().astype(np.int64 if w < 8 else np.uint64)


def release() -> None:
    """Gives memory that was freed back to the system, so that a worker kept for later tasks stays small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(texts, size: int) -> Iterator[list[bytes | None]]:
    """An Arrow array of texts as lists of about ``size`` bytes (a longer text stays whole)."""
    held: list[bytes | None] = []
    n = 0
    for text in texts:
        held.append(text.as_py())
        n += len(held[-1] or b"")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def in_chunks(batches, size: int, of=lambda row: len(row or b""), column: int = 1) -> Iterator[list[list]]:
    """Lists of columns gathered from Arrow batches until about ``size`` bytes of text (a longer row stays whole)."""
    held: list[list] | None = None
    n = 0
    for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
        cols = [c.to_pylist() for c in batch.columns]
        if held is None:
            held = [[] for _ in cols]
        start = 0
        for i, text in enumerate(cols[column]):
            n += of(text)
            if n >= size:
                for h, c in zip(held, cols, strict=True):
                    h.extend(c[start : i + 1])
                yield held
                held, n, start = [[] for _ in cols], 0, i + 1
        for h, c in zip(held, cols, strict=True):
            h.extend(c[start:])
    if held and held[0]:
        yield held
