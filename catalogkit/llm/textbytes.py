"""Whole texts as byte arrays: the shared ground of the operators that scan text in Arrow batches.

A batch's text column is one run of UTF-8 bytes with offsets. It is worked through in chunks of
whole texts of about ``CHUNK_BYTES``, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
# odd multipliers: word and n-gram hashes are polynomials modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` per run of whole texts; offsets start at 0."""
    if len(column) == 0:
        return
    data, offsets = column_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_table(letters: bytes | None = None, apart: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    """Which bytes belong to words: all but ``apart``, or only ``letters``."""
    table = np.zeros(256, bool) if letters is not None else np.ones(256, bool)
    table[list(letters if letters is not None else apart)] = letters is not None
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses from one text into the next."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of polynomial hashes over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values``; equal spans have equal hashes wherever they stand."""
    n = len(values)
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(pow(_BASE, -1, 2**64), n)
    # the length keeps apart spans that differ in trailing values of hash zero
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, by the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(_BASE, size + 1)[1:]):
        out += hashes[k : k + n] * factor
    return mixed(out)


def counts_between(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many sorted positions in ``marks`` fall into each ``[offsets[i], offsets[i + 1])``."""
    return np.diff(np.searchsorted(marks, offsets))


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each span."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[starts]


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table
