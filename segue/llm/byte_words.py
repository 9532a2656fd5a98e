"""Words of texts as arrays, by the bytes of their UTF-8: which bytes are in words is a table; only A-Z are lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from segue.llm.letters import _LETTERS, _letter, mixed

#: Words that are hashed at once.
HASHED = 100_000
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """By byte, whether it is in one of the ranges, ends included."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where in them each text begins, with the end of the last; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, at - at[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start as many as its length."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class ByteWords:
    """The words of a column of texts in order: their bytes, 64-bit hashes, and how many each text has.

    With a table of breaks, `piece` numbers what lies between breaks; it grows along the texts and differs between them.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None):
        whole, at = text_bytes(column)
        self.low = LOWER[whole]
        held = inside[self.low]
        first, last = held.copy(), held.copy()
        first[1:] &= ~held[:-1]
        last[:-1] &= ~held[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < whole.size)]
        first[edge], last[edge - 1] = held[edge], held[edge - 1]
        self.starts = np.flatnonzero(first)
        self.lengths = np.flatnonzero(last) + 1 - self.starts
        self.sizes = np.diff(np.searchsorted(self.starts, at))
        if breaks is not None:
            passed = np.searchsorted(np.flatnonzero(breaks[self.low]), self.starts)
            self.piece = passed + np.repeat(np.arange(self.sizes.size), self.sizes)

    def hashes(self) -> np.ndarray:
        found = np.empty(self.starts.size, np.uint64)
        for at in range(0, found.size, HASHED):
            found[at : at + HASHED] = self._hashes(self.starts[at : at + HASHED], self.lengths[at : at + HASHED])
        return found

    def _hashes(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        before = np.cumsum(lengths) - lengths
        place = spread(np.zeros_like(starts), lengths)
        letters = self.low[place + np.repeat(starts, lengths)]
        value = _LETTERS[((place & 31) << 8) | letters]
        if lengths.max() > 32:
            rest = np.flatnonzero(place > 31)
            value[rest] = _letter(letters[rest], place[rest])
        return mixed(np.add.reduceat(value, before))

    def strings(self, which: np.ndarray) -> pa.Array:
        """The words at some places, as strings."""
        lengths = self.lengths[which]
        data = self.low[spread(self.starts[which], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def held_together(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of slices of batches with about `size` bytes in a column, a row at least."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size - n, "right")))
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1]) - before
            at = to
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held
