"""Exact dedup of batches that arrive one after another, against immutable snapshots.

Each batch that was taken in leaves a :class:`Snapshot`: the texts it brought first, by digest, and binary fuse filters over
their digests, one for each bucket of about ``KEYS``. The digests of the next batch are dealt to the filters of their bucket;
those that pass, and only those, are joined to the snapshot's texts and compared byte by byte. Copies within a
batch are grouped by digest and whole text on their own. Texts of equal digest that differ are told apart by their bytes.

Hot groups: rows are counted before they are shuffled, filters see each digest once, and the join that tells rows
their group is a plain one that Spark splits where a key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm import fuse

#: Digests in a bucket, and so in a filter, on average.
KEYS = 4096

_FILTER = "bucket long, slice long, seed long, width long, segments long, cells binary"


@dataclass(frozen=True)
class Snapshot:
    """What one batch brought first. Nothing in it changes later."""

    texts: DataFrame  #: digest, text, head (the first text seen of its digest)
    filters: DataFrame  #: a binary fuse filter for each bucket of digests
    buckets: int


def _digest(text: Column, width: int) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, width)


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each bucket of rows that arrive by bucket; one bucket is held at a time."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        seed, width, segments, cells = fuse.build(np.concatenate(held))
        return pa.record_batch({"bucket": [now], "slice": [0], "seed": [seed], "width": [width], "segments": [segments], "cells": [cells]})

    for batch in batches:
        bucket, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "key"))
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if bucket[lo] != now:
                if held:
                    yield done()
                now, held = int(bucket[lo]), []
            held.append(key[lo:hi].astype(np.uint64))
    if held:
        yield done()


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that the filter before them lets pass; rows arrive by bucket and slice, its filter first."""
    where, test = None, None
    for batch in batches:
        # a filter's own row has no key
        cols = {c: pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in ("bucket", "slice", "key")}
        group = np.flatnonzero(np.diff(cols["bucket"]) | np.diff(cols["slice"])) + 1
        heads = np.flatnonzero(np.asarray(batch.column("cells").is_valid()))
        cuts = np.unique(np.r_[0, group, heads, heads + 1, batch.num_rows])
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            here = (cols["bucket"][lo], cols["slice"][lo])
            if batch.column("cells")[lo].is_valid:
                where, test = here, [batch.column(c)[lo].as_py() for c in ("seed", "width", "segments", "cells")]
            elif here == where:  # a bucket without a filter holds nothing
                keep[lo:hi] = fuse.passes(cols["key"][lo:hi].astype(np.uint64), *test)
        yield pa.record_batch({"digest": batch.column("digest").filter(pa.array(keep))})


def _keyed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.select("digest", key.alias("key"), F.pmod(key, F.lit(buckets)).cast("long").alias("bucket"))


def take_snapshot(texts: DataFrame) -> Snapshot:
    """The snapshot of a stored table of distinct texts (digest, text, head)."""
    digests = texts.where("head").select("digest")
    buckets = max(1, math.ceil(digests.count() / KEYS))
    rows = _keyed(digests, buckets).select("bucket", "key").repartition("bucket").sortWithinPartitions("bucket")
    return Snapshot(texts, materialize(rows.mapInArrow(_build, _FILTER)), buckets)


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Of a stored table of distinct digests those that the snapshot's filters let pass."""
    slices = max(1, math.ceil(digests.count() / (snapshot.buckets * KEYS)))
    slot = F.pmod(F.shiftright("key", 32), F.lit(slices)).cast("long")
    asked = _keyed(digests, snapshot.buckets).withColumn("slice", slot)
    filters = snapshot.filters.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    both = filters.unionByName(asked, allowMissingColumns=True).repartition("bucket", "slice")
    both = both.sortWithinPartitions("bucket", "slice", F.col("cells").isNull())
    return both.select("bucket", "slice", "seed", "width", "segments", "cells", "key", "digest").mapInArrow(_probe, "digest binary")


def ingest(batch: DataFrame, snapshots: Sequence[Snapshot] = (), *, text: str = "text", id_col: str = "doc_id", digest_bytes: int = 32):
    """Take in a batch: the class of each of its rows, and the snapshot of what it brought first.

    Returns ``(members, snapshot)``. ``members`` has ``row`` (a number within the batch), ``id``, ``sha`` and ``class``, which is
    equal for equal texts of this batch and of those behind ``snapshots``: the digest, and after it the bytes of a text that isn't the
    first of its digest. NULL texts are empty ones.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sha = F.unhex(F.sha2(whole.cast("binary"), 256))
    rows = batch.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), sha.alias("sha"))
    rows = materialize(rows.withColumn("class", F.substring("sha", 1, digest_bytes)))
    fresh = batch.select(_digest(whole, digest_bytes).alias("digest"), whole.alias("text"))
    fresh = materialize(fresh.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")))
    digests = materialize(fresh.groupBy("digest").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n")).where("n > 1"))

    # positives of each snapshot: join their bucket's texts, compare bytes
    known, heads = None, None
    asked = fresh.select("digest").distinct() if snapshots and not digests.isEmpty() else fresh.select("digest")
    for snap in snapshots:
        found = screen(asked, snap).join(fresh.select("digest", F.col("text").alias("new")), "digest").join(snap.texts, "digest")
        found = materialize(found.select("digest", "new", "head", "text", (F.col("new") == F.col("text")).alias("same")))
        same, head = found.where("same").select("digest", F.col("new").alias("text")), found.where("head").select("digest", "text", "same")
        known, heads = (same, head) if known is None else (known.unionByName(same), heads.unionByName(head))

    # texts of one digest that differ: the first one seen is the head, the others carry their bytes in the class
    split = digests.select("digest", "text")
    if snapshots:
        older = heads.select("digest", "text")
        split = split.join(older, "digest", "left_anti").unionByName(older.join(heads.where("not same").select("digest").distinct(), "digest", "left_semi"))
    split = materialize(split.distinct())
    differ = not split.isEmpty()
    if differ:
        head = split.select(F.col("digest").alias("class"), F.col("text").alias("head"))
        again = batch.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), sha.alias("sha"), whole.alias("text"))
        again = again.withColumn("class", F.substring("sha", 1, digest_bytes)).join(head, "class")
        own = F.when(F.col("text") == F.col("head"), F.col("class")).otherwise(F.concat("class", F.lit(b"\0"), F.col("text").cast("binary")))
        rows = rows.join(head, "class", "left_anti").unionByName(again.select("row", "id", "sha", own.alias("class")))
        rows = materialize(rows)
    new = fresh.select("digest", "text")
    if snapshots:
        new = new.join(known.distinct(), ["digest", "text"], "left_anti") if differ else new.join(known.select("digest").distinct(), "digest", "left_anti")
    if differ:
        new = new.join(split.withColumnRenamed("text", "first"), "digest", "left").withColumn("head", F.coalesce(F.col("text") == F.col("first"), F.lit(True)))
        new = new.drop("first")
    else:
        new = new.withColumn("head", F.lit(True))
    return rows, take_snapshot(materialize(new))


def deduplicate(batches: Sequence[DataFrame], *, text: str = "text", id_col: str = "doc_id", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of all batches, each batch screened against the snapshots of those before it.

    ``id``, ``keep_id`` (largest id of the group, NULL if it has none), ``group_size``, ``kept`` and ``sha`` (SHA-256 of the whole
    text, NULL taken as empty). Exactly one row of each group is kept: one with the largest id; of rows that repeat id and
    text, any one. NULL ids count as least. Other columns, whatever their names, are not read.
    """
    taken, members = [], None
    for k, batch in enumerate(batches):
        rows, snap = ingest(batch, taken, text=text, id_col=id_col, digest_bytes=digest_bytes)
        taken.append(snap)
        rows = rows.withColumn("batch", F.lit(k))
        members = rows if members is None else members.unionByName(rows)
    groups = members.groupBy("class").agg(F.max(F.struct("id", "batch", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups)  # so that both sides of the join are plain shuffles, of which Spark splits a hot one
    kept = (F.col("top.batch") == F.col("batch")) & (F.col("top.row") == F.col("row"))
    return members.join(groups, "class").select("id", F.col("top.id").alias("keep_id"), "group_size", kept.alias("kept"), "sha")
