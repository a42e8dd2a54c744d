"""Words of many texts at once, for use inside tasks: Arrow columns in, numpy arrays out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

POLYNOMIAL_BYTES = 32
BLOCK_BYTES = 2 << 20  # texts worked on together; a longer text is a block of its own

_OTHERS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
# digits, lower-case letters and all bytes beyond ASCII stay, the rest becomes a space
_PLAIN = bytes(32 if b in _OTHERS else b for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8; none for NULL."""
    return text.lower().translate(_PLAIN).split() if text else []


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `limit` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column in a row, and the offsets of its values; NULL is empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte values, by prefix sums."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin])


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lowered()
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
# every byte that is not part of a word of digits, letters and characters beyond ASCII
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[np.frombuffer(bytes(b for b in _OTHERS if not 65 <= b <= 90), np.uint8)] = True


class Words:
    """Words of a block of texts: byte ranges `begin`, `end`, and `first[i]:first[i + 1]` as the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES):
        self.data = LOWER[data]
        inside = ~breaks[data]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        new[filled] = inside[filled]
        closing = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[closing] = inside[closing]
        self.begin = np.flatnonzero(new)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.begin, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, for buckets."""
        return hashes_of(self.data, self.begin, self.end)

    def strong_hashes(self) -> np.ndarray:
        """64-bit hash of each word, for telling words apart.

        A polynomial modulo 2^64 is the same for some pairs of long words of regular build;
        words longer than `POLYNOMIAL_BYTES` get BLAKE2 hashes.
        """
        out = self.hashes()
        for i in np.flatnonzero(self.end - self.begin > POLYNOMIAL_BYTES):
            word = self.data[self.begin[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out
