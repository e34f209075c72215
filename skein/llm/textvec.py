"""Words, word hashes and shingle hashes of whole Arrow string columns, in numpy, without a Python loop over texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def byte_class(separators: bytes) -> np.ndarray:
    """uint8[256]: 1 for bytes that belong to words."""
    lut = np.ones(256, np.uint8)
    lut[list(separators)] = 0
    return lut


#: Words [^\x20\x09-\x0D]+, and words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased texts.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(1)
def _tables() -> tuple[np.ndarray]:
    return (np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1),)


@lru_cache(4)
def _powers(n: int, p: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin, with the end last; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else array.cast(pa.binary()).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes are within size, or single rows."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: start and end byte of each, hash of each, and the first word of each row (bounds, with the end last)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lut: np.ndarray, hashes: bool = True, lower: bool = True) -> None:
        self.bytes = LOWER[data[at[0] : at[-1]]] if lower else data[at[0] : at[-1]]
        at = at - at[0]
        n = len(self.bytes)
        word = np.zeros(n + 2, np.uint8)
        word[1:-1] = lut[self.bytes]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        inside = word.view(bool)
        self.start = np.flatnonzero(inside[1:] & ~(inside[:-1] & ~cut))
        self.end = np.flatnonzero(inside[:-1] & ~(inside[1:] & ~cut))
        self.bounds = np.searchsorted(self.start, at)
        if hashes:
            self.hash = self._hashes(n)

    def _hashes(self, n: int) -> np.ndarray:
        (random,) = _tables()
        size = max(CHUNK, 1 << n.bit_length())
        up, down = _powers(size, _P), _powers(size, pow(_P, -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(random[self.bytes] * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def prefix_hashes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, or all of a shorter one."""
        (random,) = _tables()
        n = len(self.bytes)
        size = max(CHUNK, 1 << n.bit_length())
        up, down = _powers(size, _P), _powers(size, pow(_P, -1, 1 << 64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(random[self.bytes] * up[:n], out=sums[1:])
        return mix((sums[np.minimum(self.end, self.start + k)] - sums[self.start]) * down[self.start] ^ np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and which of these lie in one row."""
        n = len(self.hash)
        out = np.zeros(n, np.uint64)
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                total *= np.uint64(0xD6E8FEB86659FD93)
                total += self.hash[j : n - k + 1 + j]
            out[: n - k + 1] = mix(total)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return out, np.arange(n) + k <= last


def rows_of(batches, column: str, inside: str | None = None, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each batch, slices of it with their text's bytes and row bounds; inside names a field of a struct column."""
    for batch in batches:
        texts = batch.column(column)
        if inside is not None:
            texts = texts.flatten()[texts.type.get_field_index(inside)]
        data, at = columns(texts)
        for i, j in chunks(at, size):
            yield batch.slice(i, j - i), data, at[i : j + 1]
