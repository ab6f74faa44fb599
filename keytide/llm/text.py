"""Vectorised text primitives for Arrow batches: words, word hashes and shingles in numpy.

All functions work on whole texts. A chunk is a run of rows with at most `CHUNK` bytes of text (one row
at least), so that temporary arrays stay small whatever the batch holds. Hashes of a longer row are taken in
blocks, so it needs a few bytes for each of its own, not tens.

Words and shingles are compared by 64-bit hashes; two different ones of n agree with probability n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bytes that separate words, [\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The words as a pattern of java.util.regex, for expressions in the JVM.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
CHUNK = 1 << 19

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd multiplier; its powers weigh the bytes of a word.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def release() -> None:
    """Gives memory that was freed back to the system: workers live on after a task, and Arrow and malloc keep what its peak took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def count_words(col: str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, null and empty: 0. Stays in the JVM."""
    return F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, `n` at least. Tables of a chunk are kept, larger ones aren't."""

    def table(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    if n > CHUNK + 1:
        return table(_BASE, n), table(_INVERSE, n)
    if not _powers:
        _powers.extend((table(_BASE, CHUNK + 1), table(_INVERSE, CHUNK + 1)))
    return _powers[0], _powers[1]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows."""
    data, offsets = buffers(col)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def padded_chunks(col: pa.Array, before: str, after: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like `chunks`, of the texts in lower case between `before` and `after`; only a chunk at a time is made."""
    _, offsets = buffers(col)
    col = col.fill_null("") if col.null_count else col
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = pc.utf8_lower(col.slice(row, end - row))
        yield row, end, *buffers(pc.binary_join_element_wise(pa.scalar(before), part, pa.scalar(after), pa.scalar("")))
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the word offsets of the rows. No word crosses a row."""
    n = len(data)
    inside = ~separator[data] if n else np.zeros(0, bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # a block of words, one at least
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        part = data[low : int(ends[j - 1])]
        power, inverse = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each position on; the last width - 1 positions are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        if width <= 8:
            own = np.zeros(b - a, np.uint64)
            for k in range(width):
                own += words[a + k : b + k] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        else:
            part = words[a : b + width - 1]
            power, inverse = _tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            own = (total[width:] - total[:-width]) * inverse[: b - a]
        out[a:b] = mix(own)
    return out


def lowest(x: np.ndarray, k: int) -> np.ndarray:
    """Where the smallest of each `k` neighbours stands, the leftmost of equal ones, by a minimum over ever wider spans."""
    out = np.empty(max(len(x) - k + 1, 0), np.int64)
    for a in range(0, len(out), CHUNK):
        low = x[a : min(a + CHUNK, len(out)) + k - 1]
        at, span = np.arange(len(low), dtype=np.int32), 1
        while span < k:
            step = min(span, k - span)
            right = low[step:] < low[:-step]
            low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        out[a : a + len(at)] = at.astype(np.int64) + a
    return out
