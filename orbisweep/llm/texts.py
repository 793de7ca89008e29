"""NumPy on the bytes of many texts at once: words, hashes of stretches, shingles.

A stretch's hash comes from prefix sums: with P[i] = sum of t(byte_j) * B^j for j < i (mod 2^64, B odd, t a
table of random numbers), the stretch [s, e) hashes to (P[e] - P[s]) * B^-s, wherever it stands. Work
goes in pieces of a few MB, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


EXACT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: The same, with A-Z read as a-z.
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
#: Space and the controls 9 to 13 separate words.
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) for runs of rows of about `limit` bytes; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


class Prefix:
    """Hashes of stretches of one piece."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * power[: len(data)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words of a piece; `gaps` says which bytes separate them."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    gap = gaps[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1] | edge[1:-1]
    after[-1], after[:-1] = True, gap[1:] | edge[1:-1]
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row: `size` words each, A-Z folded; a text of fewer words
    has one shingle of all of them, a text without words none. Hashes have 64 bits."""
    for lo, hi, data, offsets in pieces(column):
        starts, ends, owner = words(data, offsets)
        bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
        each = Prefix(data, FOLDED).of(starts, ends)
        steps = np.resize(_STEPS, size) + (np.arange(size, dtype=np.uint64) // np.uint64(5)) * np.uint64(2)
        whole = np.zeros(max(0, len(each) - size + 1), np.uint64)
        for k in range(size):
            whole += each[k: len(each) - size + 1 + k] * steps[k]
        whole = mixed(whole)
        for row in range(hi - lo):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a >= size:
                found = np.unique(whole[a: b - size + 1])
            elif b > a:
                found = mixed((each[a:b] * steps[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                found = np.zeros(0, np.uint64)
            yield lo + row, found
