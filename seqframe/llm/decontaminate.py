"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words, the smallest hash of the ``K``-word grams inside is kept, on both sides. Equal
windows keep equal hashes, so a join on kept hashes finds every shared window. The hits are then extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm.text import ALNUM, LOWER, blocks, grams, row_of, running, sliding_min, span_hash, words

WINDOW, K = 13, 8

#: Benchmark fingerprints that tasks may hold to drop misses early: 8 bytes each. Above, all fingerprints are joined by shuffle.
MAX_HELD = 4_000_000


def _fingerprints(wh: np.ndarray, wo: np.ndarray, lengths: list[int], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the winnowed grams, and of all grams as long as the short items (``lengths``)."""
    at, g = grams(wh, wo, k, short=False)
    row = row_of(wo)
    owner, width = row[at], window - k + 1
    low = sliding_min(g, width)
    inside = owner[: len(low)] == owner[width - 1 :] if len(low) else np.zeros(0, bool)
    rows, found = [owner[: len(low)][inside]], [low[inside]]
    for n in lengths:
        at, g = grams(wh, wo, n, short=False)
        rows.append(row[at])
        found.append(g)
    rows, found = np.concatenate(rows), np.concatenate(found)
    if len(found):  # a window often keeps the hash of the one before
        new = np.r_[True, (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]
        rows, found = rows[new], found[new]
    return rows, found


def _hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[buf]
    start, end, wo = words(buf, offsets, ALNUM)
    return span_hash(running(buf), start, end), wo


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One list per row."""
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _scan(lengths: list[int], held, window: int, k: int):
    """Arrow batches of (..., text) to (..., n_words, fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(batch.num_columns - 1)):
                wh, wo = _hashed(buf, offsets)
                rows, found = _fingerprints(wh, wo, lengths, window, k)
                if held is not None:
                    known = held.value
                    at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                    hit = known[at] == found if len(known) else np.zeros(len(found), bool)
                    rows, found = rows[hit], found[hit]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(np.diff(wo)), _lists(rows, found, b - a)],
                    [*batch.schema.names[:-1], "n_words", "fps"],
                )

    return run


def _item_fingerprints(items: DataFrame, window: int, k: int) -> DataFrame:
    """item, n_words, fp: winnowed grams of items of a whole window, else the one gram that is the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(1)):
                wh, wo = _hashed(buf, offsets)
                size = np.diff(wo)
                rows, found = _fingerprints(wh, wo, [], window, k)
                short = np.flatnonzero((size > 0) & (size < window))
                whole = span_hash(running(wh), wo[short], wo[short + 1])
                rows, found = np.r_[rows, short], np.r_[found, whole]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(rows)), pa.array(size[rows]), pa.array(found.view(np.int64))],
                    ["item", "n", "fp"],
                )

    return items.select("item", "text").mapInArrow(run, "item string, n long, fp long").distinct()


def _ids(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    buf = LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
    start, end, _ = words(buf, np.array([0, len(buf)]), ALNUM)
    raw = buf.tobytes()
    return np.array([vocabulary.setdefault(raw[s:e], len(vocabulary)) for s, e in zip(start.tolist(), end.tolist())], np.int64)


def extend(doc: np.ndarray, item: np.ndarray, window: int, k: int) -> np.ndarray:
    """Which words of ``doc`` lie in an occurrence of a window of ``item``: gram hits, each extended along its diagonal."""
    hit = np.zeros(len(doc), bool)
    window = min(window, len(item))
    k = min(k, window)
    if not window or len(doc) < window:
        return hit
    one = lambda x: grams(x.astype(np.uint64), np.array([0, len(x)]), k, short=False)[1]
    ours, theirs = one(doc), one(item)
    order = np.argsort(theirs, kind="stable")
    low, high = np.searchsorted(theirs[order], ours, "left"), np.searchsorted(theirs[order], ours, "right")
    diagonals: set[int] = set()
    for p in np.flatnonzero(high > low).tolist():
        diagonals.update((p - order[low[p] : high[p]]).tolist())
    for d in diagonals:
        a, b = max(0, d), min(len(doc), d + len(item))
        same = doc[a:b] == item[a - d : b - d]
        edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= window:
                hit[a + s : a + e] = True
    return hit


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    k: int = K,
    held_limit: int = MAX_HELD,
) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit (words inside any occurrence of an item window) and items (sorted ids as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one of none has none.
    NULL or empty text has no words. Items with a NULL id count for n_hit but are not listed. Repeated rows each get the
    same result; rows that share an id, or have none, are told apart by their text. No items: nothing is hit. Other columns
    are not read.

    One scan of the texts finds fingerprint hits; while the distinct benchmark fingerprints number at most ``held_limit``
    tasks hold them and drop misses at once. Only texts with hits are read again. Hot passages spread
    over documents: nothing is grouped by item or by passage.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    prints = materialize(_item_fingerprints(named, window, k))
    lengths = [r["n"] for r in prints.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than `window`
    held = None
    known = prints.select("fp").distinct()
    if known.limit(held_limit + 1).count() <= held_limit:
        found = known.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        held = spark.sparkContext.broadcast(np.sort(found))

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    kinds = f"doc {docs.schema[id_col].dataType.simpleString()}, h long, n_words long, fps array<long>"
    scanned = materialize(rows.mapInArrow(_scan(lengths, held, window, k), kinds))

    pairs = (
        scanned.where(F.size("fps") > 0)
        .select("doc", "h", F.explode(F.array_distinct("fps")).alias("fp"))
        .join(prints.select("fp", "item"), "fp")
        .select("doc", "h", "item")
        .distinct()
    )
    texts = named.where("text is not null").groupBy("item").agg(F.collect_set("text").alias("texts"))
    wanted = (
        pairs.withColumn("_k", F.coalesce("item", F.lit("")))
        .join(texts.withColumnRenamed("item", "_item").withColumn("_k", F.coalesce("_item", F.lit(""))), "_k")
        .where(F.col("item").eqNullSafe(F.col("_item")))
        .groupBy("doc", "h")
        .agg(F.collect_list(F.struct("item", "texts")).alias("candidates"))
    )
    wanted = wanted.withColumnsRenamed({"doc": "_doc", "h": "_h"})
    hits = (
        rows.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc")))
        .select("doc", "h", "text", "candidates")
        .dropDuplicates(["doc", "h"])
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, listed = [], []
            for text, candidates in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                vocabulary: dict[bytes, int] = {}
                doc = _ids(text, vocabulary)
                hit, names = np.zeros(len(doc), bool), set()
                for c in candidates:
                    for other in c["texts"]:
                        mine = extend(doc, _ids(other, vocabulary), window, k)
                        if mine.any():
                            hit |= mine
                            if c["item"] is not None:
                                names.add(c["item"])
                n_hit.append(int(hit.sum()))
                listed.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string()))],
                ["_doc", "_h", "n_hit", "items"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    checked = hits.mapInArrow(verify, f"_doc {kind}, _h long, n_hit long, items array<string>")
    return (
        scanned.join(checked, (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")
        .select(
            F.col("doc").alias(id_col),
            F.col("h").alias("text_hash"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def is_contaminated(n_hit, n_words):
    """The rule: at least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


