"""Words, shingles and their hashes over Arrow text columns, vectorised per slice.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z:
on UTF-8 bytes that is a digit, a letter a-z or any byte from 0x80 on, so words
are found without decoding. Work goes by slices of about ``SLICE`` bytes, so the
memory of a task does not grow with a batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The words of a text as a regular expression that needs no lower-casing first.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Text:
    """Some whole texts as one byte array; ``row`` numbers count from ``first``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool = True):
        self.first, self.offsets = first, offsets - offsets[0]
        raw = data[offsets[0] : offsets[-1]]
        self.data = _LOWER[raw] if lower else raw
        self.rows = len(offsets) - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes give equal hashes anywhere."""
        if not len(start):
            return np.zeros(0, np.uint64)
        power, inverse = _power(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end of each word."""
        n = len(self.data)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = _IS_WORD[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        return np.searchsorted(self.offsets, start, "right") - 1, start, end

    def string(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def texts(column: pa.Array, lower: bool = True, size: int = SLICE) -> Iterator[Text]:
    """The column in slices of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Text(data, offsets[at : to + 1], at, lower)
        at = to


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each run of ``k`` words of one row, and its hash."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[j : j + n]
    whole = np.flatnonzero(row[:n] == row[k - 1 :])
    return whole, mix(h[whole] + np.uint64(k))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the longs that Spark has."""
    return x.view(np.int64)
