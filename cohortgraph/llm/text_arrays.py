"""Word and shingle hashes of Arrow text columns, as numpy arrays over whole batches.

A batch is cut into slices of whole texts of half a MB, so memory follows the slice or the longest text, not the
batch. Words are `[^\\x20\\x09-\\x0D]+`; hashes are 64-bit, the same on every machine, and do not depend on the slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

#: Rows that are copied at once.
ROWS = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Masks that leave the first 0 to 8 bytes of a little-endian lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Lanes of a word that are added one position after another over all words; the rest of longer words comes at the end.
_LANES = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its lanes of eight bytes, each mixed with its place, summed and mixed with the length.

    Lanes go through the mixer before they are summed, so words cannot be built to collide as with polynomials."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    lengths = ends - starts
    place = mix(np.arange(1, _LANES + 1, dtype=np.uint64) * np.uint64(_BASE))
    total = mix((lanes[starts] & _FIRST[np.minimum(lengths, 8)]) ^ place[0])
    more = np.flatnonzero(lengths > 8)
    for k in range(1, _LANES):
        if not len(more):
            break
        total[more] += mix((lanes[starts[more] + 8 * k] & _FIRST[np.minimum(lengths[more] - 8 * k, 8)]) ^ place[k])
        more = more[lengths[more] > 8 * k + 8]
    if len(more):
        count = (lengths[more] + 7) // 8 - _LANES
        begin = np.cumsum(count) - count
        at = np.arange(int(count.sum())) - np.repeat(begin, count) + _LANES
        which = np.repeat(more, count)
        keys = mix((at + 1).astype(np.uint64) * np.uint64(_BASE))
        total[more] += np.add.reduceat(mix((lanes[starts[which] + 8 * at] & _FIRST[np.minimum(lengths[which] - 8 * at, 8)]) ^ keys), begin)
    return mix(total + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of whole texts of size bytes; null counts as empty. Only a few rows are copied at
    once, and what they took goes back to the system at the end, since workers live on between steps."""
    for begin in range(0, len(column), ROWS):
        part = column.slice(begin, ROWS)
        if pa.types.is_dictionary(part.type) or not pa.types.is_large_string(part.type):
            part = part.cast(pa.large_string())
        if part.null_count:
            part = part.fill_null("")
        n = len(part)
        _, where, data = part.buffers()
        offsets = np.frombuffer(where, np.int64)[part.offset : part.offset + n + 1]
        bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield begin + lo, begin + hi, bytes_[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


class Words:
    """Words of a run of texts: starts, ends, first (index of each text's first word; one more at the end), hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1] | edge[1:size]
        ends = ~space
        ends[:-1] &= space[1:] | edge[1:size]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = _word_hashes(_FOLD[data] if fold else data, self.starts, self.ends)
        self.data, self.offsets, self.space = data, offsets, space

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all runs of width words inside one text, first: index of each text's first run and the end, index of
        each run's first word). With short, a text of fewer words is one run."""
        h, n = self.hashes, self.counts()
        mult = [(_BASE * (2 * k + 3) ** 5 | 1) & _MASK for k in range(width)]
        total = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k, m in enumerate(mult):
            total += h[k : k + len(total)] * np.uint64(m)
        per = np.maximum(n - width + 1, 0)
        ends = np.cumsum(per)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - per - self.first[:-1], per)
        out = mix(total[at])
        small = np.flatnonzero((n > 0) & (n < width)) if short else np.zeros(0, np.int64)
        if len(small):
            one = [mix(np.array([(sum(int(x) * m for x, m in zip(h[self.first[i] : self.first[i + 1]], mult)) + int(n[i]) * 0x2545F4914F6CDD1D) & _MASK], np.uint64))[0] for i in small]
            where = np.concatenate(([0], ends))[small]
            out, at = np.insert(out, where, np.array(one, np.uint64)), np.insert(at, where, self.first[small])
            per[small] = 1
        return out, np.concatenate(([0], np.cumsum(per))), at


def text_bytes(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")
