"""Katz backoff language model over words.

Counts are Good-Turing discounted, and what discounting takes from the followers of a word is given to the words never seen
after it, in proportion to their own probability. Words, word pairs and backoff weights are stored as tables, the pairs by
bucket; a text is evaluated by sending its distinct pairs to their buckets and adding up what comes back per text.

Order 2: the recursion of a token is pair, word, unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import discard, materialize, release
from seqframe.llm.text import LOWER, NOT_SPACE, blocks, mix, running, span_hash, words

#: Counts up to this are discounted.
K = 5

#: Bytes of text in a batch, which one task turns into word numbers with the words of that batch alone.
BATCH = 12_000_000

#: Pairs and histories at least this frequent are held by tasks: at most FREQUENT and HOT of them, since frequencies add up to one.
FREQUENT, HOT = 1 << 20, 1 << 16

#: Tokens that a task sorts at a time, and tokens for each bucket of the pair table.
FLUSH, PER_BUCKET = 1_000_000, 1_000_000

#: Bytes of text encoded at a time.
BLOCK = 1_000_000

#: Different counts a word may have: their number is at most the root of twice the tokens, and the driver holds them.
MAX_LEVELS = 10_000_000

_END = np.uint64(0x5E0F_E0D1_C0DE_0001)


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """Good-Turing factors for counts 0..k from the numbers of types ``n[r]`` seen r times, r up to k + 1.

    Where a factor is not between 0 and 1, as with gaps in ``n``, it is that of an absolute discount; with no type seen once
    nothing is discounted.
    """
    n = n.astype(float)
    out = np.ones(k + 1)
    if n[1] <= 0:
        return out
    common = (k + 1) * n[k + 1] / n[1]
    less = n[1] / (n[1] + 2 * n[2])
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] > 0 and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - min(less, 0.9) / r
    return out


@dataclass
class Unigrams:
    """Words are numbered by falling count, so a number tells its count. Number V stands for all unknown words."""

    n: int
    v: int
    first: np.ndarray  # number of the first word of each count
    count: np.ndarray  # the counts, falling
    factor: np.ndarray

    def discounted(self, count: np.ndarray) -> np.ndarray:
        return count * np.where(count < len(self.factor), self.factor[np.minimum(count, len(self.factor) - 1)], 1.0)

    def __post_init__(self):
        per = np.diff(np.r_[self.first, self.v])
        self.kept = float((per * self.discounted(self.count)).sum())
        # if nothing was taken from seen words, one more token is left to the unknown
        self.total = float(self.n) if self.kept < self.n else self.kept + 1

    def counts(self, word: np.ndarray) -> np.ndarray:
        if not self.v:
            return np.zeros(len(word), np.int64)
        c = self.count[np.searchsorted(self.first, word, "right") - 1]
        return np.where(word < self.v, c, 0)

    def probability(self, word: np.ndarray) -> np.ndarray:
        c = self.counts(word)
        return np.where(c > 0, self.discounted(c) / self.total, 1 - self.kept / self.total)


@dataclass
class Model:
    unigrams: Unigrams
    factor: np.ndarray  # of pairs
    buckets: int
    hot: int  # words below this number are histories spread over all buckets
    pairs: DataFrame  # bucket, and arrays h, w, n ordered by h and w; oh, ow, on: those of the frequent pairs
    backoff: DataFrame  # bucket, h, total, alpha


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, the end of each text included, and the token offsets of the texts."""
    buf = LOWER[buf]
    start, end, wo = words(buf, offsets, NOT_SPACE)
    to = wo + np.arange(len(wo))
    out = np.empty(to[-1], np.uint64)
    is_end = np.zeros(to[-1], bool)
    is_end[to[1:] - 1] = True
    out[is_end] = _END
    out[~is_end] = span_hash(running(buf), start, end)
    return out, to


def _batched(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Adds the batch of each row: ranges of the id, of about BATCH bytes; a range that holds far more is split by text hash."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    place = F.coalesce(F.col("doc").cast("double"), F.lit(None).cast("double"))
    size, low, high = rows.select(F.sum(F.octet_length("text") + 8), F.min(place), F.max(place)).first()
    n = int((size or 0) // BATCH) + 1
    if low is None or low == high:
        return rows.withColumn("batch", F.pmod(F.xxhash64("text", "doc"), F.lit(n)))
    part = F.least(F.floor((place - low) / (high - low) * n).cast("long"), F.lit(n - 1))
    rows = rows.withColumn("part", F.coalesce(part, F.pmod(F.xxhash64("text"), F.lit(n))))
    sizes = rows.groupBy("part").agg(F.ceil(F.sum(F.octet_length("text") + 8) / BATCH).alias("splits"))
    most = sizes.agg(F.max("splits")).first()[0] or 1
    if most <= 3:
        return rows.withColumnRenamed("part", "batch")
    rows = rows.join(sizes, "part")
    return rows.withColumn("batch", F.xxhash64("part", F.pmod(F.xxhash64("text", "doc"), "splits"))).drop("part", "splits")


def count_words(rows: DataFrame) -> DataFrame:
    """(batch, w, n): the distinct tokens of each batch and how often training rows have them; partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, buf, offsets in blocks(batch.column(2)):
                tokens, to = _tokens(buf, offsets)
                for one in np.unique(ids[a:b]):
                    for learns in (False, True):
                        pick = np.repeat((ids[a:b] == one) & (train[a:b] == learns), np.diff(to))
                        w = np.sort(tokens[pick])
                        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
                        n = np.diff(np.r_[first, len(w)]) * learns
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), one, np.int64)), pa.array(w[first].view(np.int64)), pa.array(n)], ["batch", "w", "n"])

    found = rows.select("batch", "train", "text").mapInArrow(run, "batch long, w long, n long")
    return found.groupBy("batch", "w").agg(F.sum("n").alias("n"))


def rank_words(counted: DataFrame) -> tuple[DataFrame, Unigrams]:
    """The word table (w, n, id), ids from 0 by falling count, and what follows from it."""
    spark = counted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = counted.groupBy("w").agg(F.sum("n").alias("n")).where("n > 0")
    ordered = known.repartitionByRange(parts, F.col("n").desc(), F.col("w")).sortWithinPartitions(F.col("n").desc(), F.col("w"))
    ordered = materialize(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ordered.groupBy("part").count().orderBy("part").collect()  # one row a partition
    ahead, rows = 0, []
    for r in sizes:
        rows.append((r["part"], ahead))
        ahead += r["count"]
    table = ordered.join(spark.createDataFrame(rows, "part int, ahead long"), "part").select("w", "n", (F.col("ahead") + F.col("at")).alias("id"))
    levels = ordered.groupBy("n").count().limit(MAX_LEVELS + 1).toPandas().sort_values("n", ascending=False)
    if len(levels) > MAX_LEVELS:
        raise ValueError("too many different counts")
    count, per = levels["n"].to_numpy(np.int64), levels["count"].to_numpy(np.int64)
    of = np.zeros(K + 2)
    for r in range(1, K + 2):
        of[r] = per[count == r].sum()
    return table, Unigrams(int((count * per).sum()), int(per.sum()), np.cumsum(per) - per, count, discounts(of))


def encode(rows: DataFrame, counted: DataFrame, table: DataFrame, unigrams: Unigrams) -> DataFrame:
    """Texts as word numbers, stored: rid (batch and place in it), doc, train, ids, n_known and the add-one base score."""
    shared = rows.sparkSession.sparkContext.broadcast(unigrams)
    wide = unigrams.v >= 2**31 - 4
    kind = rows.schema["doc"].dataType.simpleString()

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        uni = shared.value
        w = known.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        w, number = w[order], known.column("id").to_numpy()[order]
        out = []
        column = texts.column("text").combine_chunks()
        for a, b, buf, offsets in blocks(column, BLOCK):
            tokens, to = _tokens(buf, offsets)
            at = np.minimum(np.searchsorted(w, tokens), max(len(w) - 1, 0))
            ids = np.where(w[at] == tokens, number[at], uni.v) if len(w) else np.full(len(tokens), uni.v)
            base = np.log10((uni.counts(ids) + 1) / (uni.n + uni.v + 1))
            score, seen = np.add.reduceat(base, to[:-1]), np.add.reduceat((ids < uni.v).astype(np.int64), to[:-1])
            lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int64 if wide else np.int32)))
            part = texts.slice(a, b - a)
            out.append(pa.Table.from_arrays([part.column("doc").combine_chunks(), part.column("train").combine_chunks(), lists, pa.array(seen), pa.array(score)], ["doc", "train", "ids", "n_known", "base"]))
        return pa.concat_tables(out)

    numbered = counted.select("batch", "w").join(table.select("w", "id"), "w")
    schema = f"doc {kind}, train boolean, ids array<{'long' if wide else 'int'}>, n_known long, base double"
    coded = rows.groupBy("batch").cogroup(numbered.groupBy("batch")).applyInArrow(run, schema)
    return materialize(coded.withColumn("rid", F.monotonically_increasing_id()), "zstd")


def _history(ids: np.ndarray, to: np.ndarray, v: int) -> np.ndarray:
    """The word before each token; v + 1 before a first word."""
    h = np.empty(len(ids), np.int64)
    h[1:] = ids[:-1]
    h[to[:-1]] = v + 1
    return h


def _bucket(h: np.ndarray, w: np.ndarray, v: int, hot: int, buckets: int) -> np.ndarray:
    code = h.astype(np.uint64)
    spread = (h < hot) | (h > v)
    code = np.where(spread, mix(code * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)), mix(code))
    return (code % np.uint64(buckets)).astype(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch], most_rows: int, consecutive: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row ids' start, tokens and offsets of runs of texts, with consecutive row ids if asked, and of about FLUSH tokens."""
    for batch in batches:
        rid = batch.column(0).to_numpy()
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        ids = np.asarray(lists.flatten())
        offsets = offsets - offsets[0]
        at = 0
        while at < len(rid):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + FLUSH, "right")) - 1)
            to = min(to, at + most_rows)
            jump = np.flatnonzero(np.diff(rid[at:to]) != 1)
            if consecutive and len(jump):
                to = at + int(jump[0]) + 1
            yield int(rid[at]), ids[offsets[at] : offsets[to]].astype(np.int64), offsets[at : to + 1] - offsets[at]
            at = to


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """All numbers of a column of lists."""
    parts = [np.asarray(c.drop_null().flatten()) for c in table.column(column).chunks]
    out = np.concatenate(parts) if parts else np.zeros(0)
    return out.astype(np.float64 if column == "alpha" else np.int64)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, and the start and end of each bucket."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(bucket) else np.zeros(1, np.int64)
    return order, edge[:-1], edge[1:]


def fit_pairs(encoded: DataFrame, unigrams: Unigrams, tokens: int) -> Model:
    """Count the pairs of the training rows and store them by bucket, with the backoff weight of every history."""
    spark = encoded.sparkSession
    uni = spark.sparkContext.broadcast(unigrams)
    v = unigrams.v
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // PER_BUCKET + 1)
    hot = int(np.searchsorted(-unigrams.count, -max(1, unigrams.n // HOT), "right"))
    hot = int(np.r_[unigrams.first, v][hot])  # words at least that frequent
    name, number, kind = ("int", np.int32, pa.int32()) if v + 2 < 2**31 else ("long", np.int64, pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, to in _flushes(batches, 1 << 30, consecutive=False):
            key = _history(ids, to, v) * (v + 2) + ids
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n, key = np.diff(np.r_[first, len(key)]), key[first]
            bucket = _bucket(key // (v + 2), key % (v + 2), v, hot, buckets)
            order, low, _ = _split(bucket)
            key, n = key[order], n[order]
            offsets = pa.array(np.r_[low, len(order)].astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key // (v + 2)).astype(number), (key % (v + 2)).astype(number), n)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[low]]), *arrays], ["bucket", "h", "w", "n"])

    def add(table: pa.Table) -> pa.Table:
        h, w, n = (_flat(table, c) for c in ("h", "w", "n"))
        key = h * (v + 2) + w
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n, key = np.add.reduceat(n, first) if len(first) else n, key[first]
        often = n > most / FREQUENT
        arrays = [pa.array([x], pa.list_(of)) for pick in (slice(None), often) for x, of in (((key[pick] // (v + 2)).astype(number), kind), ((key[pick] % (v + 2)).astype(number), kind), (n[pick], pa.int64()))]
        types = pa.array([np.bincount(n[n <= K + 1], minlength=K + 2)], pa.list_(pa.int64()))
        return pa.Table.from_arrays([table.column("bucket").slice(0, 1).combine_chunks(), *arrays, types], ["bucket", "h", "w", "n", "oh", "ow", "on", "types"])

    most = max(1, unigrams.n)
    lists = f"bucket long, h array<{name}>, w array<{name}>, n array<long>"
    partial = encoded.where("train").select("rid", "ids").mapInArrow(count, lists)
    pairs = partial.groupBy("bucket").applyInArrow(add, f"{lists}, oh array<{name}>, ow array<{name}>, on array<long>, types array<long>")
    pairs = materialize(pairs, "zstd")
    release(spark)

    of = np.zeros(K + 2)
    for r in pairs.select(F.posexplode("types").alias("n", "types")).groupBy("n").agg(F.sum("types").alias("types")).collect():
        of[r["n"]] = r["types"]
    factor = discounts(of)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a bucket at a time
                h, w, n = (np.asarray(c[k].values).astype(np.int64) for c in batch.columns[1:])
                d = np.where(n <= K, factor[np.minimum(n, K)], 1.0)
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                parts = [np.add.reduceat(x, first) if len(first) else x for x in (n, d * n, uni.value.probability(w))]
                bucket = np.full(len(first), batch.column(0)[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h[first]), *map(pa.array, parts)], ["bucket", "h", "total", "kept", "lower"])

    total = F.when(F.col("kept") < F.col("total"), F.col("total")).otherwise(F.col("total") + 1)  # always something left
    backoff = (
        pairs.select("bucket", "h", "w", "n")
        .mapInArrow(sums, "bucket long, h long, total long, kept double, lower double")
        .groupBy("h")
        .agg(F.min("bucket").alias("bucket"), *[F.sum(c).alias(c) for c in ("total", "kept", "lower")])
        .select("bucket", "h", total.alias("total"), ((1 - F.col("kept") / total) / (1 - F.col("lower"))).alias("alpha"))
    )
    return Model(unigrams, factor, buckets, hot, pairs, materialize(backoff))


def score(model: Model, encoded: DataFrame) -> DataFrame:
    """(rid, score): the log10 probability of each encoded text.

    A bucket answers a run of texts by one row of arrays, and the rows of a run meet in one group of at most as many numbers as
    the run has tokens and texts: a row for each text and bucket would grow with the product of both.
    """
    spark = encoded.sparkSession
    v, buckets, hot, factor, unigrams = model.unigrams.v, model.buckets, model.hot, model.factor, model.unigrams

    often = model.pairs.select(F.explode(F.arrays_zip("oh", "ow", "on")).alias("x")).select(F.col("x.oh").cast("long").alias("h"), F.col("x.ow").cast("long").alias("w"), F.col("x.on").alias("n"))
    often = often.join(model.backoff, "h").select("h", "w", "n", "total").toPandas()
    p = np.where(often["n"] <= K, factor[np.minimum(often["n"], K)], 1.0) * often["n"] / often["total"]
    key = often["h"].to_numpy(np.int64) * (v + 2) + often["w"].to_numpy(np.int64)
    order = np.argsort(key)
    hots = model.backoff.where((F.col("h") < hot) | (F.col("h") > v)).toPandas()
    held = spark.sparkContext.broadcast((key[order], np.log10(p.to_numpy(float)[order]) if len(order) else np.zeros(0), hots, unigrams))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, _, uni = held.value
        for rid, ids, to in _flushes(batches, 1 << 15):
            h = _history(ids, to, v)
            row = np.repeat(np.arange(len(to) - 1), np.diff(to))
            key = h * (v + 2) + ids
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            near = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            value = np.zeros(len(key))
            value[near] = logs[at[near]]
            new = h == v  # an unknown word as history backs off wholly
            value[new] = np.log10(uni.probability(ids[new]))
            mine = np.bincount(row, weights=value, minlength=len(to) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([rid % buckets]), pa.array([rid]), pa.array([[]], pa.list_(kind)), pa.array([[]], pa.list_(kind)), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int16())), pa.array([mine], pa.list_(pa.float64()))],
                names,
            )
            far = np.flatnonzero(~near & ~new)
            far = far[np.argsort(key[far], kind="stable")]
            key, docs = key[far], row[far].astype(np.int16)
            if not len(key):
                continue
            bucket = _bucket(key // (v + 2), key % (v + 2), v, hot, buckets)
            order, low, high = _split(bucket)
            for a, b in zip(low.tolist(), high.tolist()):
                part, whose = key[order[a:b]], docs[order[a:b]]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[order[a]])]), pa.array([rid]), pa.array([(part[first] // (v + 2)).astype(number)], pa.list_(kind)), pa.array([(part[first] % (v + 2)).astype(number)], pa.list_(kind)), pa.array([np.diff(np.r_[first, len(part)]).astype(np.int32)], pa.list_(pa.int32())), pa.array([whose], pa.list_(pa.int16())), pa.array([[]], pa.list_(pa.float64()))],
                    names,
                )

    name, number, kind = ("int", np.int32, pa.int32()) if v + 2 < 2**31 else ("long", np.int64, pa.int64())
    names = ["bucket", "rid", "h", "w", "ns", "docs", "sums"]

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        _, _, hots, uni = held.value
        h, w, n, own, totals, alphas = (_flat(known, c) for c in ("h", "w", "n", "own", "total", "alpha"))
        key = h * (v + 2) + w
        order = np.argsort(key)
        key, n = key[order], n[order]
        histories = np.r_[own, hots["h"].to_numpy(np.int64), v + 2]
        totals, alphas = np.r_[totals, hots["total"].to_numpy(np.int64), 1], np.r_[alphas, hots["alpha"].to_numpy(float), 1.0]
        by = np.argsort(histories)
        histories, totals, alphas = histories[by], totals[by], alphas[by]
        docs_of, values = [], []
        for k in range(asked.num_rows):
            done = np.asarray(asked.column("sums")[k].values)
            if len(done):
                docs_of.append(np.arange(len(done)))
                values.append(done)
                continue
            want = np.asarray(asked.column("h")[k].values).astype(np.int64) * (v + 2) + np.asarray(asked.column("w")[k].values)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            seen = key[at] == want if len(key) else np.zeros(len(want), bool)
            where = np.searchsorted(histories, want // (v + 2))
            where = np.where(histories[where] == want // (v + 2), where, len(histories) - 1)  # v + 2: never seen as a history
            times = np.where(seen, n[at], 0) if len(n) else np.zeros(len(want), np.int64)
            d = np.where(times <= K, factor[np.minimum(times, K)], 1.0)
            p = np.where(seen, d * times / totals[where], alphas[where] * uni.probability(want % (v + 2)))
            value = np.repeat(np.log10(p), np.asarray(asked.column("ns")[k].values))
            docs = np.asarray(asked.column("docs")[k].values).astype(np.int64)
            used = np.unique(docs)
            docs_of.append(used)
            values.append(np.bincount(docs, weights=value)[used])
        if not asked.num_rows:  # a bucket that no text asks
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int16())), pa.array([], pa.list_(pa.float64()))], ["rid", "docs", "part"])
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in values])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.concatenate(docs_of).astype(np.int16), np.concatenate(values))]
        return pa.Table.from_arrays([asked.column("rid").combine_chunks().cast(pa.int64()), *lists], ["rid", "docs", "part"])

    def add(parts: pa.Table) -> pa.Table:
        """The sums of the texts of one run of :func:`_flushes`, whose number in the run is ``docs``."""
        docs, part = _flat(parts, "docs"), np.concatenate([np.asarray(c.flatten()) for c in parts.column("part").chunks])
        total = np.bincount(docs, weights=part)  # every text of the run is in the row of its held pairs
        return pa.table({"rid": parts.column("rid")[0].as_py() + np.arange(len(total)), "score": total})

    asked = encoded.select("rid", "ids").mapInArrow(ask, f"bucket long, rid long, h array<{name}>, w array<{name}>, ns array<int>, docs array<short>, sums array<double>")
    weights = model.backoff.where((F.col("h") >= hot) & (F.col("h") <= v)).groupBy("bucket").agg(F.collect_list(F.struct("h", "total", "alpha")).alias("x"))
    weights = weights.select("bucket", F.col("x.h").alias("own"), F.col("x.total").alias("total"), F.col("x.alpha").alias("alpha"))
    known = model.pairs.select("bucket", "h", "w", "n").unionByName(weights, allowMissingColumns=True)
    found = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "rid long, docs array<short>, part array<double>")
    return found.groupBy("rid").applyInArrow(add, "rid long, score double")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows for which ``train`` holds and score all rows: the id, train, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are runs of other than blank bytes, A-Z lower-cased, and one end a text; NULL is an empty text, which has one token.
    base_score is the add-one unigram log10 probability, score that of the Katz model. A NULL ``train`` does not teach. Rows are scored
    one by one, repeated rows too; ids need not be unique and may be NULL. Without training rows every token is unknown, with
    probability one. Other columns are not read.

    What is learned grows with the corpus and stays in tables; the driver and tasks hold the different counts, and the pairs and
    histories above a fixed share of all tokens, whose numbers are bounded by it.
    """
    rows = _batched(docs, id_col, text_col, train)
    counted = materialize(count_words(rows))
    release(docs.sparkSession)
    table, unigrams = rank_words(counted)
    encoded = encode(rows, counted, table, unigrams)
    discard(counted)
    model = fit_pairs(encoded, unigrams, unigrams.n)
    release(docs.sparkSession)
    scored = encoded.select("rid", "doc", "train", F.size("ids").cast("long").alias("n_tokens"), "n_known", "base").join(score(model, encoded), "rid")
    return scored.select(
        F.col("doc").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.lit(unigrams.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
