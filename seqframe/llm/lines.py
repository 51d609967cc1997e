"""Line dedup by content-defined chunks.

Every line is hashed, and a rolling hash over the last ``ROLL`` line hashes decides whether a chunk ends after a line. The
borders depend on nearby lines alone, so a passage is cut alike wherever it stands. A chunk of several lines that
occurs again is removed there, once its bytes have been compared. With ``runs`` the chunks are all pairs of consecutive
lines instead: their union is every shared run of at least two lines, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import discard, materialize
from seqframe.llm.text import blocks, mix, row_of, running, span_hash

#: Lines in the rolling hash, lines between borders on average, lines a removable chunk has at least.
ROLL, EVERY, LEAST = 2, 3, 2


def _chunks(buf: np.ndarray, offsets: np.ndarray, roll: int, every: int):
    """Row, first byte, byte after the last line and number of lines of every chunk; chunks tile their document.

    The line break after a chunk's last line is not part of it.
    """
    sums = running(buf)
    n = len(offsets) - 1
    size = np.diff(offsets)
    breaks = np.flatnonzero(buf == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    lo = np.r_[0, np.cumsum(per)]  # line offsets of the documents
    start = np.empty(lo[-1], np.int64)
    end = np.empty(lo[-1], np.int64)
    is_first, is_last = np.zeros(lo[-1], bool), np.zeros(lo[-1], bool)
    is_first[lo[:-1]] = is_last[lo[1:] - 1] = True
    start[is_first], start[~is_first] = offsets[:-1], breaks + 1
    end[is_last], end[~is_last] = offsets[1:], breaks
    h = span_hash(sums, start, end)
    row = row_of(lo)
    first = np.maximum(np.arange(len(h)) - roll + 1, lo[:-1][row])
    cut = (span_hash(running(h), first, np.arange(1, len(h) + 1)) >> np.uint64(11)) % np.uint64(every) == 0
    cut |= is_last
    last = np.flatnonzero(cut)
    begin = np.r_[0, last[:-1] + 1]
    keep = size[row[last]] > 0
    last, begin = last[keep], begin[keep]
    return row[last], start[begin], end[last], last - begin + 1, span_hash(sums, start[begin], end[last]), per, n


def _pairs(buf: np.ndarray, offsets: np.ndarray):
    """Row, first byte, byte after the last line, number of lines (2) and hash of every two consecutive lines."""
    row, start, end, lines, code, _, _ = _chunks(buf, offsets, 1, 1)
    on = np.flatnonzero(row[1:] == row[:-1])
    return row[on], start[on], end[on + 1], lines[on] + lines[on + 1], mix(code[on] * np.uint64(3) + code[on + 1])


def _merged(removed: list[dict], raw: bytes) -> list[dict]:
    """Spans that share a line as one."""
    out: list[dict] = []
    for r in removed:
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = r["end"]
        else:
            out.append(dict(r))
    for r in out:
        r["lines"] = raw.count(b"\n", r["start"], r["end"]) + 1
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    carry: tuple[str, ...] = (),
    roll: int = ROLL,
    every: int = EVERY,
    least: int = LEAST,
    runs: bool = False,
) -> DataFrame:
    """Per row of ``docs``: the id, n_lines, n_removed (lines), n_chunks (removed) and ``kept``, the text without them.

    The first occurrence of a chunk stays: that of the smallest id (NULL last), then of the smallest text hash, then the
    earliest in the text. Repeated rows with one id and text are one document, so they lose the same chunks. Kept lines are joined
    by line breaks; ``kept`` is NULL only for NULL text. An empty text has one empty line, which is no chunk. Chunks of fewer
    than ``least`` lines are never removed. Columns named in ``carry`` come along as fields of ``row``; no other is read.

    With ``runs`` every run of two or more lines that stands earlier goes, its first and last line too, and ``n_chunks`` counts runs;
    ``roll``, ``every`` and ``least`` do not matter. Every line still stays where it stands first.

    Only hashes and offsets of chunks are shuffled until repeated ones are known; the bytes of those are compared by
    grouping on them, which combines on the map side, so a passage found in a third of all documents stays small.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    whole = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.struct(*[F.col(c) for c in carry or (id_col,)]).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in blocks(batch.column(2)):
                if runs:
                    row, start, end, lines, code = _pairs(buf, offsets)
                    use = lines == 2
                else:
                    row, start, end, lines, code, _, _ = _chunks(buf, offsets, roll, every)
                    use = lines >= least
                row = row[use]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a).take(pa.array(row)) for c in batch.columns[:2]]
                    + [pa.array(x) for x in (start[use] - offsets[row], end[use] - offsets[row], lines[use], code[use].view(np.int64))],
                    ["doc", "h", "start", "end", "lines", "code"],
                )

    chunks = materialize(rows.mapInArrow(cut, f"doc {kind}, h long, start long, end long, lines long, code long"))
    twice = chunks.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    spans = (
        chunks.join(twice, "code", "left_semi")
        .groupBy("doc", "h")
        .agg(F.collect_set(F.struct("start", "end", "lines", "code")).alias("spans"))
        .withColumnsRenamed({"doc": "_doc", "h": "_h"})
    )
    same = (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc"))
    marked = rows.join(spans, same)
    bytes_of = F.col("text").cast("binary")
    seen = marked.dropDuplicates(["doc", "h"]).select("doc", "h", bytes_of.alias("bytes"), F.explode("spans").alias("s"))
    seen = seen.select("doc", "h", "s.*", F.expr("substring(bytes, cast(s.start + 1 as int), cast(s.end - s.start as int))").alias("chunk"))
    seen = materialize(seen)
    discard(chunks)  # and with it the shuffle of the texts that ends here
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "h", "start")
    firsts = seen.groupBy("code", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = (
        seen.join(firsts, ["code", "chunk"])
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc", "h")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "lines"))).alias("removed"))
        .withColumnsRenamed({"doc": "_doc", "h": "_h"})
    )
    out = whole.join(again, same, "left")
    out = out.withColumn("removed", F.coalesce("removed", F.expr("array()").cast("array<struct<start:long,end:long,lines:long>>")))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_removed, n_chunks = [], [], [], []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8")
                if runs:
                    removed = _merged(removed, raw)
                parts, at, gone = [], 0, False
                for r in removed:
                    if r["start"] > at:
                        parts.append(raw[at : r["start"] - 1])  # without the break before the chunk
                    at, gone = r["end"] + 1, r["end"] == len(raw)
                if not gone:
                    parts.append(raw[at:])
                kept.append(None if text is None else b"\n".join(parts).decode("utf-8"))
                n_lines.append(raw.count(b"\n") + 1)
                n_removed.append(sum(r["lines"] for r in removed))
                n_chunks.append(len(removed))
            counts = [pa.array(x, pa.int64()) for x in (n_lines, n_removed, n_chunks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), *counts, pa.array(kept, pa.string())], names)

    names = ["doc", "h", "row", "n_lines", "n_removed", "n_chunks", "kept"]
    picked = out.select("doc", "text", "removed", "h", "row")
    schema = picked.select("doc", "h", "row").schema
    for name in names[3:6]:
        schema = schema.add(name, "long")
    result = picked.mapInArrow(rewrite, schema.add("kept", "string"))
    columns = [F.col("doc").alias(id_col), F.col("h").alias("text_hash"), *names[3:]]
    return result.select(*columns, *(["row"] if carry else []))
