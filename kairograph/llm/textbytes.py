"""Vectorised helpers over UTF-8 text held in Arrow batches.

Everything here runs inside Python workers on bounded slices of a batch, so a
worker's memory follows the slice size and the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

#: Bytes of a word that are hashed and compared as whole arrays; what is longer goes to the library one by one.
_WIDE = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text has a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


def pieces(column: pa.Array, rows: int = 512, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows of a string column, copied a few rows at a time."""
    for at in range(0, len(column), rows):
        data, offsets = byte_column(column.slice(at, rows))
        for a, b in row_slices(offsets, limit):
            yield at + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def release() -> None:
    """Gives free memory back at the end of a task: workers live on, and their executors' memory is shared."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes hash alike wherever they stand.

    Eight bytes at a time go through ``mix``, so no pattern of bytes cancels out.
    Different bytes may still share a hash: ``distinct_spans`` compares them.
    """
    n = ends - starts
    eight = _words_at(data)
    h = mix(n.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    wide = np.flatnonzero(n > _WIDE)
    for at in range(0, int(min(n.max(initial=0), _WIDE)), 8):
        own = np.flatnonzero((n > at) & (n <= _WIDE))
        h[own] = mix((h[own] ^ (eight[starts[own] + at] & _MASKS[np.minimum(n[own] - at, 8)])) + np.uint64(0x9E3779B97F4A7C15))
    if len(wide):
        h[wide] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)]
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of its span of ``other``."""
    n = ends - starts
    same = n == to - from_
    left, right = _words_at(data), _words_at(other) if other is not data else None
    right = left if right is None else right
    for at in range(0, int(min(n.max(initial=0), _WIDE)), 8):
        own = np.flatnonzero(same & (n > at) & (n <= _WIDE))
        same[own] = ((left[starts[own] + at] ^ right[from_[own] + at]) & _MASKS[np.minimum(n[own] - at, 8)]) == 0
    for i in np.flatnonzero(same & (n > _WIDE)).tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[from_[i] : to[i]])
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each different span, and each occurrence's place among these; hashes only group, bytes decide."""
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[at[back]], ends[at[back]]))
    if len(odd):
        more: dict[bytes, int] = {}
        extra: list[int] = []
        for i in odd.tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in more:
                more[word] = len(at) + len(extra)
                extra.append(i)
            back[i] = more[word]
        at = np.concatenate([at, extra])
    return at, back


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of the texts, and where each text's words start."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive word hashes within each text, and each text's first shingle.

    ``first`` has the position of each text's first word and the word count at
    its end. A text of fewer than ``size`` words has no shingle.
    """
    n = len(words)
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if n < size:
        return np.zeros(0, np.uint64), bounds
    h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[j : n - size + 1 + j]
    h = mix(h)
    return h[np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])], bounds
