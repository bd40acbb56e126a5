"""Whole texts of an Arrow batch as numpy arrays: words, word hashes and hashes of word runs.

Texts are handled in chunks of about a megabyte, so that memory in a task does not grow with the
batch; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        tables = []
        for step in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size > 1 << 21:  # one long text must not leave its tables behind
            return tables[0], tables[1]
        known = _powers[base] = (tables[0], tables[1])
    return known


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` consecutive values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    forth, back = powers(_WORD_BASE, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * back[:n])


def byte_table(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern, np.uint8)] = True
    return table


NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")


@dataclass
class Texts:
    """Some whole texts: `data[offsets[i]:offsets[i + 1]]` is text i, which is row `first + i`."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def spans(self, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes in the table, and the first run of each text."""
        n = len(self.data)
        inside = in_word[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, self.offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        forth, back = powers(_BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * forth[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * back[starts])


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a string column in chunks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
