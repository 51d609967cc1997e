"""Suffix arrays by prefix doubling, and permuted common prefixes, over numpy arrays.

Suffixes are sorted by their first few symbols, packed into one number, and numbered in that order; the numbers of two suffixes that
stand k symbols apart then order the first of them by twice as many symbols. A number that no other suffix has is final, so
only suffixes that still share their prefix are sorted again.
"""

from __future__ import annotations

import numpy as np


def _starts(value: np.ndarray) -> np.ndarray:
    """Whether a new value begins."""
    new = np.empty(len(value), bool)
    new[:1] = True
    np.not_equal(value[1:], value[:-1], out=new[1:])
    return new


def _alone(new: np.ndarray) -> np.ndarray:
    """Whether a value begins and ends here."""
    return new & np.r_[new[1:], True]


def _sorted(value: np.ndarray, at: np.ndarray, low: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` (below 2**low) by value (below 2**bits) and position, and where a new value begins."""
    if bits + low > 63:
        order = np.argsort(value, kind="stable")
        return at[order], _starts(value[order])
    key = (value << low) | at  # sorts far faster than positions do
    key.sort()
    return key & ((1 << low) - 1), _starts(key >> low)


def _packed(text: np.ndarray, most: int) -> tuple[np.ndarray, int, int]:
    """The first k symbols of every suffix as one number, k, and the bits of that number, at most about ``most``."""
    there = np.bincount(text) > 0
    code = (np.cumsum(there) - 1)[text]
    bits = max(1, (int(there.sum()) - 1).bit_length())
    k = max(1, most // bits)
    out = code.copy()
    for j in range(1, k):
        out <<= bits
        out[: max(0, len(text) - j)] |= code[j:]
    return out, k, k * bits


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``: whole numbers from 0 on of which only the last is 0."""
    n = len(text)
    low = n.bit_length()
    value, k, bits = _packed(text, 63 - low)
    sa, new = _sorted(value, np.arange(n), low, bits)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.sort(sa[~_alone(new)])
    while len(at):
        order, new = _sorted((rank[at] << low) | rank[at + k], at, low, 2 * low)  # a prefix that others share ends before the 0
        i, base = np.arange(len(order)), rank[order]
        inside = i - np.maximum.accumulate(np.where(_starts(base), i, 0))
        sa[base + inside] = order
        rank[order] = base + inside - (i - np.maximum.accumulate(np.where(new, i, 0)))
        at = np.sort(order[~_alone(new)])
        k *= 2
    return sa


def shared_suffixes(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a suffix array that shares: suffixes whose first ``depth`` symbols another one has too, in the order of these.

    Equal ones are consecutive and by position; also returns where new ones begin. ``left`` is the number of symbols from each position to the
    end of its row; suffixes with fewer than ``depth`` are left out.
    """
    low = len(text).bit_length()
    value, most, bits = _packed(text, 63 - low)
    steps = [depth]
    while steps[-1] > most:
        steps.append((steps[-1] + 1) // 2)
    k = steps.pop()
    value >>= bits // most * (most - k)
    at = np.flatnonzero(left >= k)
    order, new = _sorted(value[at], at, low, bits)
    while True:
        again = ~_alone(new)
        order, new = order[again], new[again]
        if not steps:
            return order, new
        rank = np.full(len(text), -1, np.int64)
        rank[order] = np.cumsum(new) - 1
        ahead = steps[-1] - k
        k = steps.pop()
        at = np.flatnonzero((rank >= 0) & (left >= k))
        at = at[rank[at + ahead] >= 0]
        order, new = _sorted((rank[at] << low) | rank[at + ahead], at, low, 2 * low)


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position (permuted, in text order) the bytes its suffix shares with the one before it in ``sa``, at most ``most``.

    Eight bytes are compared at a time, for the positions still equal.
    """
    n = len(data)
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = data
    word = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    out = np.zeros(n, np.int64)
    limit = np.minimum(most, n - np.maximum(at, before[at]))
    shared = 0
    while len(at):
        x = word[at + shared] ^ word[before[at] + shared]
        part = np.zeros(len(at), np.int64)
        for k in range(1, 9):
            part += (x << np.uint64(64 - 8 * k)) == 0 if k < 8 else x == 0
        out[at] = np.minimum(shared + part, limit)
        go = (part == 8) & (limit > shared + 8)
        at, limit = at[go], limit[go]
        shared += 8
    return out
