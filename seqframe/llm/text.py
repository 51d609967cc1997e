"""Words, spans and their hashes over whole Arrow string batches, as numpy arrays.

A batch of texts is one byte array with document offsets. Words are found by a byte-class table, and every span
is hashed from running sums, so no Python code runs per word. All hashes are 64 bits wide and depend
on the bytes alone, so every task and every run gives a text the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Byte tables: A-Z to a-z, and the two word classes in use (all bytes of non-ASCII letters belong to words).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers, _inverse = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a 64-bit finalizer)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def running(values: np.ndarray) -> np.ndarray:
    """Running sums that :func:`span_hash` reads: length ``len(values) + 1``."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``values[start:end]``; equal spans of equal length hash alike wherever they stand."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64) * U64(_STEP))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """:func:`span_hash` of every ``width`` consecutive values."""
    _, inv = powers(len(sums))
    out = sums[width:] - sums[:-width]
    out *= inv[: len(out)]
    out += U64(width * _STEP % 2**64)
    return mix(out)


def blocks(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary array at row borders into blocks of about ``most`` bytes; a longer text is a block of its own.

    Yields first row, row after the last, the bytes and the offsets of the block's rows. NULL is empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes in ``table``, and the word offsets of each document."""
    inside = table[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The document of every item, from the item offsets of the documents."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(hashes: np.ndarray, offsets: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all ``k`` consecutive items of each document.

    With ``short`` a document of fewer items, but not none, has one gram of all its items.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    position = np.arange(n)
    last = np.repeat(offsets[1:], np.diff(offsets))
    keep = position + k <= last
    if short:
        first = np.repeat(offsets[:-1], np.diff(offsets))
        keep |= position == first
    at = position[keep]
    return at, span_hash(running(hashes), at, np.minimum(at + k, last[keep]))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


