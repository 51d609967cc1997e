"""Removal of repeated passages, to the byte, with suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a smaller id, or before it in the
same text. Equal strings hold the same smallest ``GRAM``-byte hash at the same place (their anchor), so all of them are
among the neighbourhoods of one anchor hash. Neighbourhoods whose hash occurs again are sorted by suffix array, shard by shard, to the
depth of ``LENGTH`` bytes, which gives the classes of equal strings; of each class the earliest stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import discard, materialize, release
from seqframe.llm.suffix import shared_suffixes
from seqframe.llm.text import blocks, mix, row_of, running, sliding_min, span_hash, window_hash

LENGTH, GRAM = 100, 40

#: Different neighbourhoods of one hash in a shard, and bytes of a suffix array.
SHARD, ARRAY = 2048, 1 << 19

#: Bytes of text hashed at a time, few enough for a CPU's cache.
BLOCK = 1 << 18


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of a block and their gram hashes, and the running sums of the bytes.

    The anchor of a string is the first of its grams whose leading 32 hash bits are smallest, which its bytes alone decide.
    """
    gram = min(GRAM, length)
    sums = running(buf)
    n = len(buf) - gram + 1
    if n < 1 or len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    h = window_hash(sums, gram)
    low = sliding_min((h & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64), length - gram + 1)
    edge = np.zeros(len(buf) + 1, np.int64)  # strings that start in the last bytes of a text run over its end
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    inside = np.cumsum(edge[:-1]) == 0
    found = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside[: len(low)]]
    found = found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
    return found, h[found], sums


def _neighbourhood(at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings that may have this anchor, inside the text low..high."""
    reach = length - min(GRAM, length)
    return np.maximum(low, at - reach), np.minimum(high, at + length)


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]] if len(start) else np.zeros(0, bool)
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] if len(start) else end


def _count_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in blocks(batch.column(0), BLOCK):
                h = np.sort(_anchors(buf, offsets, length)[1])
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)]))], ["h", "n"])

    return run


def _place_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(2), BLOCK):
                at, h, _ = _anchors(buf, offsets, length)
                row = np.searchsorted(offsets, at, "right") - 1
                part = [c.slice(a, b - a).take(pa.array(row)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*part, pa.array(h.view(np.int64)), pa.array(at - offsets[row])], ["doc", "th", "h", "at"])

    return run


def _describe(length: int):
    """(doc, th, text, ats) to one row a neighbourhood: doc, th, gram hash, content hash, start and end in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(2), BLOCK):
                lists = batch.column(3).slice(a, b - a)
                counts = np.diff(np.asarray(lists.offsets))
                row = np.repeat(np.arange(b - a), counts)
                at = np.asarray(lists.flatten()).astype(np.int64) + offsets[row]
                sums = running(buf)
                start, end = _neighbourhood(at, offsets[row], offsets[row + 1], length)
                h = span_hash(sums, at, at + min(GRAM, length))
                f = mix(span_hash(sums, start, end) + (at - start).astype(np.uint64))
                part = [c.slice(a, b - a).take(pa.array(row)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(start - offsets[row]), pa.array(end - offsets[row])],
                    ["doc", "th", "h", "f", "start", "end"],
                )

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, text, [(h, sub, split, start, end)]) to one row a neighbourhood with its bytes."""
    for batch in batches:
        for a, b, buf, offsets in blocks(batch.column(2)):
            lists = batch.column(3).slice(a, b - a)
            row = row_of(np.asarray(lists.offsets))
            h, sub, split, start, end = lists.flatten().flatten()
            low, high = (offsets[row] + x.to_numpy() for x in (start, end))
            raw = buf.tobytes()
            cut = [raw[i:j] for i, j in zip(low.tolist(), high.tolist())]
            part = [c.slice(a, b - a).take(pa.array(row)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([h, sub, split, *part, start, pa.array(cut, pa.binary())], ["h", "sub", "split", "doc", "th", "start", "bytes"])


def _shards(length: int, array_bytes: int):
    """Neighbourhoods, those of a shard consecutive, to removed runs and, for split hashes, the earliest of each class of strings."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        column = table.column(6).combine_chunks().cast(pa.large_binary())
        ((_, _, buf, offsets),) = blocks(column, most=1 << 62)
        size = np.diff(offsets)
        row = row_of(offsets)
        left = np.repeat(offsets[1:], size) - np.arange(len(buf))
        sa, new = shared_suffixes(buf, left, length)
        doc, th, first = (table.column(i).to_numpy() for i in (3, 4, 5))
        order = np.lexsort((th, doc))
        changed = np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(th[order]) != 0)]
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(changed)
        place = (rank << 40)[row[sa]] + (first - offsets[:-1])[row[sa]] + sa  # earlier strings first
        begins = np.flatnonzero(new)
        gone = np.zeros(len(buf), bool)
        if len(sa):
            gone[sa] = place > np.repeat(np.minimum.reduceat(place, begins), np.diff(np.r_[begins, len(sa)]))
        start = np.flatnonzero(gone)
        owner = row[start]
        jump = np.flatnonzero(np.r_[True, (np.diff(start) > length) | (np.diff(owner) != 0)]) if len(start) else np.zeros(0, np.int64)
        run_start = start[jump]
        run_end = start[np.r_[jump[1:] - 1, len(start) - 1]] + length if len(start) else run_start
        owner = row[run_start]
        split = np.zeros(len(buf), bool)
        split[np.repeat(table.column(2).to_numpy(), size)] = True
        chosen = np.flatnonzero(split & (left >= length) & ~gone)  # the earliest of each class, alone in it or not
        sums = running(buf)
        w = span_hash(sums, chosen, chosen + length)
        w2 = span_hash(running(buf[::-1]), len(buf) - chosen - length, len(buf) - chosen)
        pick = np.r_[owner, row[chosen]]
        nothing = np.zeros(len(owner), np.int64)
        begin = np.r_[run_start, chosen]
        yield pa.RecordBatch.from_arrays(
            [table.column(i).combine_chunks().take(pa.array(pick)) for i in (3, 4)]
            + [pa.array(begin - offsets[:-1][pick] + first[pick]), pa.array(np.r_[run_end, chosen + length] - offsets[:-1][pick] + first[pick])]
            + [pa.array(np.r_[nothing, w.view(np.int64)]), pa.array(np.r_[nothing, w2.view(np.int64)]), pa.array(np.arange(len(pick)) >= len(owner))],
            ["doc", "th", "start", "end", "w", "w2", "open"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            h, sub = table.column(0).to_numpy(), table.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (sub[1:] != sub[:-1]), True])
            ends = np.cumsum(np.asarray(pa.compute.binary_length(table.column(6))))
            at, done = 0, 0
            for e in edge[1:].tolist():
                if e == len(table) and not last:
                    break
                if ends[e - 1] - done >= array_bytes or e == len(table):
                    yield from work(table.slice(at, e - at))
                    at, done = e, int(ends[e - 1])
            if at < len(table):
                kept.extend(table.slice(at).to_batches())

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                if sum(b.nbytes for b in kept) >= 2 * array_bytes:
                    yield from cut(False)
        if kept:
            yield from cut(True)

    return run


def _finish(with_bytes: bool):
    """(id, text, [(start, end)]) to (id, n_bytes, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(1)):
                lists = batch.column(2).slice(a, b - a)
                base = offsets + np.arange(len(offsets))  # a gap after each text, so that no run goes on into the next
                at = base[row_of(np.asarray(lists.offsets))]
                start, end = _runs(*(at + x.to_numpy() for x in lists.flatten().flatten()))
                owner = np.searchsorted(base, start, "right") - 1
                first = np.searchsorted(owner, np.arange(len(offsets)))
                n_removed = np.diff(np.r_[0, np.cumsum(end - start)][first])
                start, end = (start - owner).tolist(), (end - owner).tolist()
                raw, border, edge = memoryview(buf.tobytes()), offsets.tolist(), first.tolist()
                kept, digest = [], []
                for k in range(b - a):
                    i, j = edge[k], edge[k + 1]
                    rest = b"".join([raw[x:y] for x, y in zip([border[k], *end[i:j]], [*start[i:j], border[k + 1]])])
                    kept.append(rest if with_bytes else None)
                    digest.append(hashlib.sha256(rest).hexdigest())
                counts = [pa.array(x.astype(np.int64)) for x in (np.diff(offsets), n_removed, np.diff(first))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *counts, pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["doc", "n_bytes", "n_removed", "n_spans", "kept", "sha"]
                )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, with_bytes: bool = True, shard: int = SHARD, array_bytes: int = ARRAY
) -> DataFrame:
    """Per row of ``docs``: the id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left) and kept_sha256.

    Texts are UTF-8 bytes, NULL is empty; strings never cross texts and are judged on the input. NULL ids come after all others;
    rows that share an id are ordered by a hash of their text, and rows that repeat id and text are one document and get the
    same result. Texts shorter than ``length`` bytes keep everything. ``kept`` is NULL without ``with_bytes``. Other columns are not read.

    Anchors are about one in ``length / 2`` bytes. Only their hashes are counted over the corpus; a hash that occurs once costs no
    more. Equal neighbourhoods are merged before they are sorted, wherever they come from; the different ones of one hash
    are spread over shards of at most about ``shard``, whose classes are then merged by the hash of their string.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    last = F.lit(2**63 - 1)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    keys = ["doc", "th"]

    again = rows.select("text").mapInArrow(_count_anchors(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = materialize(again)
    release(docs.sparkSession)
    anchors = rows.select(*keys, "text").mapInArrow(_place_anchors(length), "doc long, th long, h long, at long")
    lists = anchors.join(again, "h", "left_semi").groupBy(*keys).agg(F.collect_set(F.col("at")).alias("ats"))
    some = materialize(rows.join(lists, keys))
    discard(again)

    near = some.dropDuplicates(keys).select(*keys, "text", "ats").mapInArrow(_describe(length), "doc long, th long, h long, f long, start long, end long")
    near = materialize(near)
    release(docs.sparkSession)
    place = F.struct("doc", "th", "start")
    equal = materialize(near.groupBy("h", "f").agg(F.min(F.struct("doc", "th", "start", "end")).alias("first"), F.count("*").alias("n")))
    copies = near.join(equal.where("n > 1"), ["h", "f"]).where(place != F.struct("first.doc", "first.th", "first.start"))
    copies = copies.where(F.col("end") - F.col("start") >= length).select(*keys, "start", "end")

    many = equal.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    sub = F.pmod(F.col("f"), F.ceil(F.col("kinds") / shard))
    wanted = equal.join(many, "h").select("h", sub.alias("sub"), (F.col("kinds") > shard).alias("split"), "first.*")
    wanted = wanted.groupBy(*keys).agg(F.collect_list(F.struct("h", "sub", "split", "start", "end")).alias("parts"))
    pieces = some.select(*keys, "text").join(wanted, keys).dropDuplicates(keys).select(*keys, "text", "parts")
    pieces = pieces.mapInArrow(_cut_out, "h long, sub long, split boolean, doc long, th long, start long, bytes binary")
    pieces = pieces.repartition(parts, "h", "sub").sortWithinPartitions("h", "sub")
    release(docs.sparkSession)
    sorted_ = materialize(pieces.mapInArrow(_shards(length, array_bytes), "doc long, th long, start long, end long, w long, w2 long, open boolean"))
    release(docs.sparkSession)  # the bytes dealt to shards
    open_ = sorted_.where("open").select(*keys, "start", "end", "w", "w2")
    first = open_.groupBy("w", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    merged = open_.join(first, ["w", "w2"]).where(place > F.col("first")).select(*keys, "start", "end")

    spans = copies.unionByName(sorted_.where("not open").select(*keys, "start", "end")).unionByName(merged)
    spans = materialize(spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    discard(near, equal, sorted_)
    empty = F.expr("array()").cast("array<struct<start:long,end:long>>")
    touched = some.join(spans, keys, "left").select("id", "text", F.coalesce("spans", empty).alias("spans"))
    touched = touched.mapInArrow(_finish(with_bytes), f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept binary, sha string")
    kept = F.col("text") if with_bytes else F.lit(None).cast("binary")
    none = F.lit(0).cast("long")
    whole = rows.select(*keys, "id", F.octet_length("text").cast("long").alias("n_bytes"), kept.alias("kept"), F.sha2("text", 256).alias("sha"))
    whole = whole.join(some.select(*keys).distinct(), keys, "left_anti")
    whole = whole.select(F.col("id").alias("doc"), "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept", "sha")
    out = touched.unionByName(whole)
    kept = F.col("kept") if with_bytes else F.lit(None).cast("binary")
    return out.select(F.col("doc").alias(id_col), "n_bytes", "n_removed", "n_spans", kept.alias("kept"), F.col("sha").alias("kept_sha256"))
