"""Arrow string columns as flat numpy arrays: words, hashes and rolling windows.

Every helper works on one *slice*: a run of rows whose texts together stay
under ``SLICE_BYTES`` (a single longer text makes a slice of its own), so a
task's memory follows the slice and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

#: Bytes that are not U+0020 or U+0009..U+000D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of letters and digits; every byte of a non-ASCII character counts.
ALNUM = np.zeros(256, bool)
ALNUM[128:] = True
for _a, _b in ("09", "az", "AZ"):
    ALNUM[ord(_a) : ord(_b) + 1] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Of the C library, where it has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, b, U64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        have = _tables[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives free memory back to the system. A worker is used again for other stages; what one of them has freed but still
    holds would add to what the next ones need."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the row offsets. Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's first word (one more entry than rows)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = inside[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    inner = offs[offs < n]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[offs[offs > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = powers(_BYTE_BASE, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of the k words from each position on; k - 1 fewer entries than words."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start in the row) of every window of k words that stays in one row."""
    hashes = window_hashes(words, k)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[first[:-1][rows] + places], rows, places
