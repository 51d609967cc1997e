"""Static binary fuse filters in numpy: a set of 64-bit keys in about nine bits a key.

A filter never misses a key that it was built from and lets another pass once in 256 times. It is built by peeling: a cell
that only one remaining key uses belongs to that key, and all such keys are taken out together, layer by layer; cells
are then filled in the opposite order.
"""

from __future__ import annotations

import math

import numpy as np

from seqframe.llm.text import U64, mix

_STEP = 0x9E3779B97F4A7C15


def _cells(keys: np.ndarray, seed: int, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each key, in neighbouring segments of ``width`` cells, and its fingerprint."""
    h = mix(keys + U64((seed + 1) * _STEP % 2**64))
    first = ((h >> U64(32)) * U64(segments * width)) >> U64(32)
    inside = U64(width - 1)
    at = np.stack([first, (first + U64(width)) ^ ((h >> U64(18)) & inside), (first + U64(2 * width)) ^ (h & inside)], axis=1)
    return at.astype(np.int64), ((h ^ (h >> U64(32))) & U64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment width, number of first segments and the cells of a filter over ``keys`` (repeated keys count once)."""
    keys = np.unique(keys)
    n = len(keys)
    size = max(n, 2)
    width = 1 << min(18, max(2, int(math.log(size) / math.log(3.33) + 2.25)))
    segments = max(1, math.ceil(size * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(size)) / width) - 2)
    seed = 0
    while (cells := _filled(keys, seed, width, segments)) is None:
        seed += 1
        segments += seed % 8 == 0  # no seed has failed eight times so far but over tiny sets
    return seed, width, segments, cells.tobytes()


def _filled(keys: np.ndarray, seed: int, width: int, segments: int) -> np.ndarray | None:
    """The cells, or None if some keys can't be peeled under this seed."""
    at, prints = _cells(keys, seed, width, segments)
    length = (segments + 2) * width
    users = np.bincount(at.ravel(), minlength=length)
    key_sum = np.zeros(length, np.int64)  # of the numbers of the keys that use a cell: of a single one, its number
    np.add.at(key_sum, at.ravel(), np.repeat(np.arange(len(keys)), 3))
    layers, free, left = [], np.flatnonzero(users == 1), len(keys)
    while len(free):
        key, one = np.unique(key_sum[free], return_index=True)
        layers.append((key, free[one]))
        left -= len(key)
        touched = at[key].ravel()
        np.subtract.at(users, touched, 1)
        np.subtract.at(key_sum, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        free = touched[users[touched] == 1]
    if left:
        return None
    cells = np.zeros(length, np.uint8)
    for key, own in reversed(layers):  # the own cell is still 0, so it may join the sum
        cells[own] = prints[key] ^ np.bitwise_xor.reduce(cells[at[key]], axis=1)
    return cells


def passes(keys: np.ndarray, seed: int, width: int, segments: int, cells: bytes) -> np.ndarray:
    """Whether the filter holds each key, perhaps wrongly."""
    at, prints = _cells(keys, seed, width, segments)
    return np.bitwise_xor.reduce(np.frombuffer(cells, np.uint8)[at], axis=1) == prints
