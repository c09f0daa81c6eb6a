"""Word hashing over Arrow string columns with numpy: no Python object per word."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

#: ASCII white space, the separators of words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are (safe inside UTF-8).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIME = 0x9E3779B185EBCA87
_SPAN = 1 << 16


@functools.lru_cache(1)
def _trimmer():
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run):
    """run, a function of Arrow batches, giving its freed memory back to the system when a task ends: a Python worker outlives its tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trimmer():
                trim(0)

    return tidied


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_PRIME, _SPAN)
_POW_FAR = int(_POW[-1]) * _PRIME % (1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls count as empty) and each row's start and the last end in them."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Parts of batch whose texts hold about `most` bytes (one row at least), so that numpy's temporaries stay bounded."""
    if not len(batch):
        return
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row: their starts and ends in data, and each row's first word (n + 1 entries)."""
    solid = np.concatenate([[False], ~IS_SPACE[data], [False]])
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edge] = solid[1:-1][edge]
    last[edge - 1] = solid[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shift = np.repeat(starts - begins, sizes)
    within = np.arange(len(shift)) + shift
    value = data[within].astype(np.uint64) + np.uint64(1)
    within -= np.repeat(starts, sizes)
    if int(sizes.max()) <= _SPAN:
        value *= _POW[within]
    else:  # words longer than the table of powers
        far = _powers(_POW_FAR, int(sizes.max()) // _SPAN + 1)
        value *= _POW[within % _SPAN] * far[within // _SPAN]
    return mix(np.add.reduceat(value, begins) + sizes.astype(np.uint64) * np.uint64(_PRIME))


def chain(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash for each tuple of hashes."""
    h = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(_PRIME) + p)
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each row the sorted distinct hashes of its k-word shingles (its whole word sequence if shorter; empty without words)."""
    starts, ends, first = words(data, offsets)
    w = word_hashes(data, starts, ends)
    whole = chain([w[i : len(w) - k + 1 + i] for i in range(k)], k) if len(w) >= k else None
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield chain([w[a + i : a + i + 1] for i in range(b - a)], b - a)
        else:
            yield w[:0]
