"""Words of many texts as arrays of hashes: texts are looked at as one array of characters, not word by word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once.
CHUNK_CHARS = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letter(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed((code.astype(np.uint64) + np.uint64(1)) * MIX + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


#: Hashes of the first 256 characters at the first 32 places of a word.
_LETTERS = _letter(np.tile(np.arange(256), 32), np.repeat(np.arange(32), 256))


@lru_cache(2)
def inside(kind: str) -> np.ndarray:
    """By code point, whether it is in a word: what is no white space (`plain`), or letters, digits, underscores (`word`); the last place is for all others."""
    if kind == "plain":
        return np.array([not chr(c).isspace() for c in range(0x3001)] + [True])
    return np.array([chr(c).isalnum() or c == 0x5F for c in range(0x110000)])


class Words:
    """The words of texts in lower case: hashes of letters, where each word begins, its length, and how many words each text has.

    A letter's hash depends on its place in the word; a word's is the mixed sum of its letters'.
    """

    def __init__(self, texts: list[str], kind: str = "plain"):
        low = [t.lower() for t in texts]
        whole, table = "\n".join([*low, ""]), inside(kind)
        codes = np.frombuffer(whole.encode("ascii"), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        held = table[codes if codes.itemsize == 1 else np.minimum(codes, table.size - 1)]
        edge = np.flatnonzero(held[1:] != held[:-1]) + 1
        if held.size and held[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        letters, self.lengths = codes[held], ends - starts
        self.before = np.cumsum(self.lengths) - self.lengths
        place = np.arange(letters.size) - np.repeat(self.before, self.lengths)
        self.letters = _LETTERS[((place & 31) << 8) | (letters & 255)]
        if starts.size and (self.lengths.max() > 32 or letters.itemsize > 1):
            rest = np.flatnonzero((place > 31) | (letters > 255))
            self.letters[rest] = _letter(letters[rest], place[rest])
        self.sizes = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in low])), prepend=0)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(self.sizes.size), self.sizes)

    def hashes(self) -> np.ndarray:
        return mixed(np.add.reduceat(self.letters, self.before)) if self.before.size else np.zeros(0, np.uint64)

    def starts_of(self, which: np.ndarray, k: int) -> np.ndarray:
        """The hashes of the first k letters of some words, which have k at least: those of such words."""
        first = self.letters[self.before[which]].copy()
        for i in range(1, k):
            first += self.letters[self.before[which] + i]
        return mixed(first)


def word_hash(word: str) -> int:
    (found,) = Words([word], "word").hashes().tolist()
    return found


def grouped(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner, then hash; where in it each distinct (owner, hash) begins."""
    if not hashes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes)
    ordered = hashes[order]
    rank = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    key = owner[order] * (rank[-1] + 1) + rank
    again = np.argsort(key)
    key = key[again]
    return order[again], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about CHUNK_CHARS bytes in a column, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, "right")))
            yield batch.slice(at, to - at)
            at = to
