"""Runs of periodic words by string synchronising sets.

A run is a longest stretch of words with smallest period q that holds q at least ``EXPONENT`` times. For each power of two t a
set of positions is chosen by hashes of t words: a position is in the set if the least hash of the t + 1 windows that begin at it
and after it stands at either end. Membership depends on the next 2t words alone, so it is the same wherever these words stand,
and every t positions hold one, unless all of them begin windows of a period of at most t / 4. Such highly periodic windows are
left out of the set of scale t; the runs they lie in have a small period and were found at a smaller scale, and periods below
``DIRECT`` by comparing words directly.

A run of period t <= q < 2t therefore has a chosen position with the same 2t words q further on, and none between: consecutive
positions of equal context propose their distance, and the proposal is extended word by word on both sides. Word numbers are
exact; a context is a 64-bit hash.

A task works on blocks of documents joined by words that occur nowhere else, and needs some 200 bytes a word of a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqframe.llm.text import NOT_SPACE, U64, blocks, mix, sliding_min, words

#: Times the period that a run is long, fewest words of a run, and periods found by comparing words directly.
EXPONENT, LEAST, DIRECT = 4, 6, 4

_OUT = U64(2**64 - 1)
_FACTOR = U64(0xC2B2AE3D27D4EB4F)


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _small(w: np.ndarray, found: list) -> None:
    for q in range(1, DIRECT):
        lo, hi = _stretches(w[:-q] == w[q:])
        long = hi - lo >= (EXPONENT - 1) * q
        lo, hi = lo[long], hi[long]
        if q > 1 and len(lo):  # of q = 2 and 3 the only smaller period that divides it is 1
            own = ~np.all(w[lo[:, None] + np.arange(q)] == w[lo][:, None], axis=1)
            lo, hi = lo[own], hi[own]
        found.extend(zip(lo.tolist(), (hi - lo + q).tolist(), [q] * len(lo), strict=True))


def _reach(w: np.ndarray, i: int, d: int) -> tuple[int, int]:
    """The longest stretch around ``i`` in which words ``d`` apart are equal: its start and the end of the words that it covers."""
    lo, step = i, 2 * d
    while lo > 0:
        a = max(0, lo - step)
        differ = np.flatnonzero(w[a:lo] != w[a + d : lo + d])
        if len(differ):
            lo = a + int(differ[-1]) + 1
            break
        lo, step = a, 2 * step
    hi, step, last = i, 2 * d, len(w) - d
    while hi < last:
        b = min(last, hi + step)
        differ = np.flatnonzero(w[hi:b] != w[hi + d : b + d])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = b, 2 * step
    return lo, hi + d


def _periodic(at: np.ndarray, t: int, found: list) -> np.ndarray:
    """Which of the positions ``at`` begin a window of ``t`` words of a period of at most ``t`` / 4."""
    edge = np.zeros(len(at) + 1, np.int64)
    for start, length, q in found:
        if q * EXPONENT <= t <= length:
            i = int(np.searchsorted(at, start))
            if i < len(at) and at[i] == start:  # else its document is too short for this scale
                edge[i] += 1
                edge[i + length - t + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def find_runs(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period.

    ``w`` holds the word numbers of the documents, each followed by one that occurs once; ``sizes`` counts a document's words
    without it.
    """
    found: list[tuple[int, int, int]] = []
    _small(w, found)
    at = np.arange(len(w))
    size = np.repeat(sizes, sizes + 1)
    h = mix(w.astype(U64))  # of the t words from each position
    t = 1
    while t < DIRECT:
        h, t = _double(h, t), 2 * t
    longest = int(sizes.max(initial=0))
    while EXPONENT * t <= longest:
        stay = size >= EXPONENT * t
        if np.count_nonzero(stay) * 2 < len(stay):
            w, at, size, h = w[stay], at[stay], size[stay], h[stay]
        context = _double(h, t)
        ids = h >> U64(1)
        if found:
            ids[_periodic(at, t, found)] = _OUT
        if len(ids) > t:
            least = sliding_min(ids, t + 1)
            n = len(least)
            i = np.flatnonzero((least != _OUT) & ((ids[:n] == least) | (ids[t : t + n] == least)))
            order = np.argsort(context[i], kind="stable")
            i, c = i[order], context[i[order]]
            gap = np.diff(i)
            pair = np.flatnonzero((c[1:] == c[:-1]) & (gap >= t) & (gap < 2 * t))
            _extend(w, at, i[pair], gap[pair], found)
        h, t = context, 2 * t
    if not found:
        return (np.zeros(0, np.int64),) * 3
    runs = np.array(found, np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    runs = runs[runs[:, 1] >= LEAST]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _double(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2t words from those of t words; a window that passes the end holds the last document's own word."""
    return mix(h + _FACTOR * np.r_[h[t:], np.zeros(min(t, len(h)), U64)])


def _extend(w: np.ndarray, at: np.ndarray, first: np.ndarray, gap: np.ndarray, found: list) -> None:
    """Extend proposals (by position); those within a stretch of the same distance that is already known add nothing."""
    known: dict[int, int] = {}
    order = np.argsort(first, kind="stable")
    for i, d in zip(first[order].tolist(), gap[order].tolist(), strict=True):
        if i + d < known.get(d, 0):
            continue
        lo, hi = _reach(w, i, d)
        known[d] = hi
        if hi - lo >= EXPONENT * d:
            found.append((int(at[lo]), hi - lo, d))


def _block(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of a block of documents."""
    starts, ends, of = words(buf, offsets, NOT_SPACE)
    n, docs, lens = len(starts), len(offsets) - 1, ends - starts
    bounds = np.r_[0, np.cumsum(lens)].astype(np.int64)
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[NOT_SPACE[buf]]))])
    ids = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(of)
    w = np.empty(n + docs, np.int64)
    place = np.arange(n) + np.repeat(np.arange(docs), sizes)
    ends_at = of[1:] + np.arange(docs)
    w[place], w[ends_at] = ids, n + np.arange(docs)
    start, length, period = find_runs(w, sizes)

    drop = np.zeros(n + docs + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop[:-1])[place] == 0
    doc = np.searchsorted(ends_at, start)
    begin = np.r_[0, ends_at[:-1] + 1] if docs else ends_at
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start - begin[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"]),
    )

    # kept words, each followed by a space, of which a document's last one goes
    src, size = starts[keep], lens[keep] + 1
    to = np.r_[0, np.cumsum(size)]
    byte = np.repeat(src - to[:-1], size) + np.arange(to[-1])
    out = buf[np.minimum(byte, max(len(buf) - 1, 0))]
    out[to[1:] - 1] = 0x20
    left = np.r_[0, np.cumsum(keep)][of]  # kept words before each document
    edges = to[left]
    last = edges[1:][np.diff(left) > 0] - 1
    solid = np.ones(len(out), bool)
    solid[last] = False
    edges = edges - np.r_[0, np.cumsum(np.diff(left) > 0)]
    text = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[solid])))
    return pa.array(sizes, pa.int64()), lists, text


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in blocks(batch.column(batch.num_columns - 1)):
            sizes, runs, text = _block(buf, offsets)
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*rest, sizes, runs, text.cast(pa.string())], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, *, text: str | Column = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` lists start (word number from 0), length and period in words, by start, then period. ``collapsed`` is the text without
    the words that lie in any run after its first period, joined by single spaces. Words are cut at spaces, tabs and line
    breaks of ASCII. A NULL or blank text has no words, no runs and an empty text. Rows may repeat.
    """
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [docs.schema[c] for c in carry]
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    return docs.select(*[F.col(f"`{c}`") for c in carry], column.alias("_text")).mapInArrow(_batches, T.StructType([*fields, *new]))


def repeat_words(text: Column, doc_id: Column) -> Column:
    """The damage that the registered query does to one in ten texts: from some word on, a few words over and over.

    Texts of a NULL id stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def damaged(found: Column) -> Column:
        n = F.size(found)
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        moved = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(found, (moved(i) + 1).cast("int"))), " ")

    found = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    new = F.get(F.transform(F.array(found), damaged), 0)  # so that the words are found once a text, not once a word
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), new).otherwise(text)


def summary(found: DataFrame) -> DataFrame:
    """Digests of :func:`collapse_runs` and its longest run (of equal ones the first, then the one of the smallest period)."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    top = F.get(F.array_sort(order), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["s"].alias("start"),
        (-top["l"]).alias("length"),
        top["p"].alias("period"),
        F.floor(F.lit(-1000) * top["l"] / top["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
