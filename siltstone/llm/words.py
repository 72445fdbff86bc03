"""Words of whole Arrow batches as numpy arrays: spans, 64-bit hashes and a hash table.

Everything works on the UTF-8 bytes of a batch at once, so the cost is a few nanoseconds a byte.
Two different byte strings get the same hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True

_random = np.random.default_rng(20240229)
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_CODE = np.where(SPACES, np.uint64(0), BYTE_CODE)
_POWER = np.ones(4096, np.uint64)
_POWER[1:] = np.cumprod(np.full(4095, 0x9E3779B97F4A7C15, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n - 1, 0x9E3779B97F4A7C15, np.uint64))])
    return _POWER


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end
        row = end


def span_hash(data: np.ndarray, starts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A hash of each span that begins at starts and ends at the next start; bytes of code 0 count as absent at a span's end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    value = code[data[starts[0] :]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, starts - starts[0]))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a word (a run without white space inside one row) begins."""
    dark = ~SPACES[data]
    first = dark.copy()
    first[1:] &= ~dark[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = dark[edge]
    return np.flatnonzero(first)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, the word's start, first word of each row with the total at the end)."""
    starts = word_starts(data, offsets)
    hashes = span_hash(LOWER[data] if lower else data, starts, WORD_CODE)
    return hashes, starts, np.searchsorted(starts, offsets)


class HashIndex:
    """64-bit keys to row numbers, by vectorised linear probing; made for up to `most` keys."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        slots = 1 << max(4, (2 * most - 1).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.rows = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        found = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            row, hit = self.rows[slot], self.keys[slot] == keys[left]
            used = row >= 0
            got = used & hit
            found[left[got]] = row[got]
            more = used & ~hit
            left, slot = left[more], (slot[more] + np.uint64(1)) & self.mask
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Gives distinct, absent keys the next row numbers and returns these."""
        rows = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = np.flatnonzero(self.rows[slot] < 0)
            self.rows[slot[free]] = rows[left[free]]
            self.keys[slot[free]] = keys[left[free]]
            more = self.rows[slot] != rows[left]
            left, slot = left[more], (slot[more] + np.uint64(1)) & self.mask
        return rows
