"""Batches of texts as byte arrays: words, and polynomial hashes of any stretch from prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: ASCII white space ends a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Any odd number has an inverse modulo 2^64, so the hash of [i, j) is (P[j] - P[i]) / BASE^i.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, so that the low bits of a hash depend on more than the low bits of the bytes.
_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(base: int, have: np.ndarray, n: int) -> np.ndarray:
    if len(have) >= n:
        return have
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Prefix sums of a byte array from which the hash of any stretch follows at once."""

    def __init__(self, data: np.ndarray):
        global _power, _inverse
        _power, _inverse = _powers(BASE, _power, len(data) + 1), _powers(_INVERSE, _inverse, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte[data] * _power[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _inverse[start]


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, len(size)


def data_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one place more than texts). A null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or places[-1] == places[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def words_of(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (one place more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = places[1:-1][(places[1:-1] > 0) & (places[1:-1] < len(data))]
    opens[edge] = inside[1:-1][edge]
    closes[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, places)


#: Longer words are hashed one by one.
_LONG = 64
_tail = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes after eight bytes through ``mix``.

    No polynomial: those modulo 2^64 give one value to some words of 1024 letters whatever the base.
    """
    size = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    left = np.arange(len(size))
    for k in range(0, _LONG, 8):
        left = left[(size[left] > k) & (size[left] <= _LONG)]
        if not len(left):
            break
        chunk = eight[start[left] + k] & _tail[np.minimum(size[left] - k, 8)]
        out[left] = mix((out[left] ^ chunk) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k))
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 (64 bits) of each stretch."""
    raw, out = memoryview(np.ascontiguousarray(data)), np.zeros(len(start), np.uint64)
    for k in range(0, len(start), 65_536):  # few places as Python numbers at once
        some = slice(k, k + 65_536)
        out[some] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[some].tolist(), end[some].tolist())]
    return out
