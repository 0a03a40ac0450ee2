"""Words of many texts at once, as numpy arrays over the Arrow buffers.

Texts of a record batch are handled in blocks of bounded bytes, so that the
temporary arrays stay small whatever the batch holds; a single longer text is
a block of its own. Word and n-gram identities are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words between ASCII white space, and runs of letters, digits and non-ASCII bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(_SPACES)] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, or more, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > BLOCK_BYTES:  # a very long text; not worth keeping
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, ends = text_bytes(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of a block: start, end (bytes), doc (row of the block), and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        inside = keep[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[filled] = inside[filled]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """One hash per word, of its lower-cased bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(len(self.data))
        term = BYTE[self.data]
        term *= up[:len(term)]
        total = np.cumsum(term)
        h = total[self.end - 1] - total[self.start] + term[self.start]
        h *= down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def words_of(column: pa.Array, keep: np.ndarray) -> Words:
    return Words(*text_bytes(column), keep)


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of n neighbouring words; len(h) - n + 1 of them, documents ignored."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(h) - n + 1
    out = np.full(size, salt, dtype=np.uint64)
    for k, c in enumerate(seeds(n, 0xA5A5 + n) | np.uint64(1)):
        out += h[k:k + size] * c
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles.

    A text of fewer words is one shingle, one without words has none.
    """
    w = words_of(column, NOT_SPACE)
    h = w.hashes()
    grams = ngrams(h, n)
    out = []
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], int(b - a), salt=1))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def flat(lists: list[np.ndarray], dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All values end to end, and the row each belongs to."""
    if not lists:
        return np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int64)
    return np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column from all values and the number in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
