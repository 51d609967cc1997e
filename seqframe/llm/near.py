"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

A text is the weighted set of its five-word shingles, each weighing its count times its inverse document frequency. Consistent weighted
samples of two texts agree with the probability of their weighted Jaccard similarity; samples are banded to find
candidates, and each candidate pair is verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm.graph import components
from seqframe.llm.text import ALNUM, LOWER, blocks, grams, mix, row_of, running, span_hash, words

WORDS, THRESHOLD = 5, 0.8

#: BANDS * ROWS samples: a pair at the threshold shares a band with probability 1 - (1 - 0.8**4)**16 > 0.9997.
BANDS, ROWS = 16, 4

#: Samples drawn, of which the first are banded and all estimate the similarity of a candidate pair: the deviation is below 0.03 at
#: the threshold, so LIKELY lies three deviations under it.
SAMPLES = 192

#: Document frequencies are kept in a count-min sketch of this fixed size, so tasks hold 8 * DEPTH * WIDTH bytes whatever the input.
DEPTH, WIDTH = 2, 1 << 20

#: Rows of a bucket that one task compares at a time, and how often larger buckets are split by a further band.
CHUNK, LEVELS = 1024, 4

#: Sample agreement below which a pair is not verified; from which a text counts as attached to a bucket's leader; and from which
#: one leader is enough. A text attached to ATTACH leaders does not lead itself.
LIKELY, ALIKE, SAME, ATTACH = 0.71, 0.8, 0.88, 2

#: Bytes of text on either side of a tile in which texts of different groups are verified.
TILE_BYTES = 8 << 20

#: Random variates of the sampling come from this many drawn values for each sample.
_POOL = 4096
_BITS = 12  # texts in a block; shingles keep the other bits


def _shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of the distinct shingles of each row, ordered by row."""
    buf = LOWER[buf]
    start, end, wo = words(buf, offsets, ALNUM)
    at, g = grams(span_hash(running(buf), start, end), wo, k)
    key = (row_of(wo)[at].astype(np.uint64) << np.uint64(64 - _BITS)) | (g >> np.uint64(_BITS))
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(64 - _BITS)).astype(np.int64), key & np.uint64((1 << (64 - _BITS)) - 1), count


def _cells(shingle: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    return [(mix(shingle + np.uint64(0x9E37 * (i + 1))) % np.uint64(width)).astype(np.int64) for i in range(depth)]


def frequency_sketch(docs: DataFrame, text_col: str, k: int = WORDS, depth: int = DEPTH, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """Count-min sketch (depth x width) of the document frequencies of all shingles, and the number of texts that have any.

    Each task adds up one sketch; parts of the sketches are added by part, so the result and every step is bounded by
    the size of a sketch.
    """
    part = min(width, 1 << 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((depth, width), np.int64), 0
        for batch in batches:
            for a, b, buf, offsets in _small(batch.column(0)):
                row, shingle, _ = _shingles(buf, offsets, k)
                n += len(np.unique(row))
                for i, cell in enumerate(_cells(shingle, depth, width)):
                    sketch[i] += np.bincount(cell, minlength=width)
        if n:
            flat = sketch.reshape(-1, part)
            used = np.flatnonzero(flat.any(axis=1))
            small = np.int32 if sketch.max() < 2**31 else np.int64
            for i in used.tolist():
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int64()), "n": pa.array([0], pa.int64()), "counts": pa.array([flat[i].astype(small).tobytes()], pa.binary()), "wide": pa.array([small is np.int64])})
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int64()), "n": pa.array([n], pa.int64()), "counts": pa.array([b""], pa.binary()), "wide": pa.array([False])})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(part, np.int64), 0
        for frame in frames:
            n += int(frame["n"].sum())
            for counts, wide in zip(frame["counts"], frame["wide"]):
                if counts:
                    total += np.frombuffer(counts, np.int64 if wide else np.int32)
        yield pd.DataFrame({"part": [key[0]], "n": [n], "counts": [total.tobytes()]})

    parts = docs.select(text_col).mapInArrow(count, "part long, n long, counts binary, wide boolean")
    sketch, n = np.zeros((depth * width // part, part), np.int64), 0
    for r in parts.groupBy("part").applyInPandas(add, "part long, n long, counts binary").collect():
        if r["part"] < 0:
            n = r["n"]
        else:
            sketch[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return sketch.reshape(depth, width), n


def _small(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of fewer than 2**_BITS rows."""
    most = (1 << _BITS) - 1
    for a, b, buf, offsets in blocks(column):
        for s in range(a, b, most):
            e = min(b, s + most)
            o = offsets[s - a : e - a + 1]
            yield s, e, buf[o[0] : o[-1]], o - o[0]


def idf(shingle: np.ndarray, sketch: np.ndarray, n: int) -> np.ndarray:
    """From 2 for a shingle of one text down to 1 for one of all texts.

    The floor of 1 keeps groups of thousands of near copies together: what they share never weighs less than half of
    what sets one apart. A sketch cell is corrected by what other shingles add to it on average.
    """
    depth, width = sketch.shape
    total = sketch[0].sum()
    df = np.full(len(shingle), np.inf)
    for i, cell in enumerate(_cells(shingle, depth, width)):
        seen = sketch[i][cell]
        df = np.minimum(df, seen - (total - seen) / (width - 1))
    df = np.clip(df, 1, max(n, 1))
    return 1 + np.log((1 + n) / (1 + df)) / np.log(1 + max(n, 1))


def _variates(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) variates r, shifted logs of gamma(2, 1) variates less r, and uniforms beta."""
    rng = np.random.default_rng(20)
    u = 1 - rng.random((5, samples, _POOL))
    r = -np.log(u[0] * u[1])
    log_c = np.log(-np.log(u[2] * u[3]))
    return r.astype(np.float32), (log_c - r + 1000).astype(np.float32), (1 - u[4]).astype(np.float32)


def sample(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, samples: int, variates) -> np.ndarray:
    """``samples`` consistent weighted samples (32 bits each) of ``n`` rows; rows without shingles get zeros."""
    r, g, beta = variates
    out = np.zeros((n, samples), np.uint32)
    step = 1 << 14
    log_w = np.log(weight).astype(np.float32)
    best = np.full((samples, n), np.iinfo(np.int64).max, np.int64)
    for a in range(0, len(row), step):
        s, lw, rows = shingle[a : a + step], log_w[a : a + step], row[a : a + step]
        edge = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        owner = rows[edge]
        for d in range(samples):
            code = s * np.uint64(2 * (d + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
            at = (code >> np.uint64(52)).astype(np.intp)
            rate, shift = r[d].take(at), beta[d].take(at)
            t = np.floor(lw / rate + shift)
            t_less = (t - shift) * rate
            low = (g[d].take(at) - t_less).view(np.int32).astype(np.int64) << 32  # positive, so its bits sort as it does
            name = ((code ^ (code >> np.uint64(29))) + t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
            low |= (name >> np.uint64(32)).view(np.int64)
            least = np.minimum.reduceat(low, edge)
            best[d, owner] = np.minimum(best[d, owner], least)
    have = np.unique(row)
    out[have] = (best[:, have] & 0xFFFFFFFF).astype(np.uint32).T
    return out


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the value, of all values of the ranges start..stop."""
    size = stop - start
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + (start - np.cumsum(size) + size)[which]


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, copy, tiny, big, bucket), those of a slot consecutive, to likely pairs (u, v) and the leaders of big slots.

    The first text of a slot that is not yet attached to enough leaders becomes its next leader. It is compared with the texts still
    looking for leaders, and if no leader attached it, with all others too. All slots of a slice advance together. Of its likely
    partners each text offers the likeliest alone, so a slot gives no more pairs than it has texts.
    """
    kept: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        bucket = table.column(0).to_numpy()
        sig = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(bucket), -1)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        stop = np.r_[edge[1:], len(bucket)]
        begin = edge
        need = np.full(len(bucket), ATTACH, np.int64)
        led = np.zeros(len(bucket), bool)
        best, whom, leaders = np.zeros(len(bucket)), np.full(len(bucket), -1), []
        while len(edge):
            rest, index = _spread(edge, stop)  # each slot's next leader: its first text in need
            lead = np.full(len(edge), -1)
            on = np.flatnonzero(need[index] > 0)[::-1]
            lead[rest[on]] = index[on]
            go = lead >= 0
            begin, edge, stop, lead = begin[go], edge[go], stop[go], lead[go]
            if not len(lead):
                break
            lost = need[lead] == ATTACH
            led[lead] = True
            need[lead] = 0
            leaders.append(lead)
            of, index = _spread(np.where(lost, begin, lead + 1), stop)
            use = ~led[index] & ((need[index] > 0) | lost[of])
            of, index = lead[of[use]], index[use]
            for a in range(0, len(index), 1 << 17):
                i, o = index[a : a + (1 << 17)], of[a : a + (1 << 17)]
                agree = (sig[i] == sig[o]).mean(axis=1)
                better = agree > best[i]  # a text meets one leader at a time
                best[i[better]], whom[i[better]] = agree[better], o[better]
                order = np.lexsort((agree, o))
                top = order[np.flatnonzero(np.r_[o[order][1:] != o[order][:-1], True])]  # and a leader its likeliest text
                top = top[agree[top] > best[o[top]]]
                best[o[top]], whom[o[top]] = agree[top], i[top]
                need[i] -= (agree >= ALIKE).astype(np.int64) + (agree >= SAME) * (ATTACH - 1)
            edge = lead + 1
            go = edge < stop
            begin, edge, stop = begin[go], edge[go], stop[go]
        copies = table.column(1)
        lead = np.concatenate(leaders) if leaders else np.zeros(0, np.int64)
        big = lead[table.column(3).to_numpy()[lead]]
        offers = np.flatnonzero(best >= LIKELY)
        left, right = np.r_[offers, big], np.r_[whom[offers], big]
        n = len(offers)
        return pa.RecordBatch.from_arrays(
            [copies.take(pa.array(left)).combine_chunks(), copies.take(pa.array(right)).combine_chunks(), table.column(4).take(pa.array(left)).combine_chunks(), pa.array(np.arange(len(left)) >= n)],
            ["u", "v", "origin", "leader"],
        )

    def flush(more: bool) -> Iterator[pa.RecordBatch]:
        """All whole buckets; the last may go on in the next batch."""
        table = pa.Table.from_batches(kept)
        kept.clear()
        cut = len(table)
        if more and cut:
            bucket = table.column(0).to_numpy()
            other = np.flatnonzero(bucket != bucket[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            kept.extend(table.slice(cut).to_batches())
        if cut:
            yield work(table.slice(0, cut))

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= 8 * CHUNK:
                yield from flush(True)
    if kept:
        yield from flush(False)


def _candidates(texts: DataFrame) -> DataFrame:
    """Likely pairs (u > v) of copies from distinct texts (copy, keys, tiny)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: DataFrame | None = None
    keyed = texts.select("copy", F.explode("keys").alias("bucket"))
    for _ in range(LEVELS):
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        chunk = F.pmod(F.xxhash64("copy"), F.ceil(F.col("size") / CHUNK))
        big = F.col("size") > CHUNK
        slots = (
            keyed.join(sizes, "bucket")
            .withColumns({"big": big, "slot": F.when(big, F.xxhash64("bucket", chunk)).otherwise(F.col("bucket"))})
            .join(texts.select("copy", "tiny"), "copy")
            .select("slot", "copy", "tiny", "big", "bucket")
        )
        pairs = materialize(
            slots.repartition(parts, "slot").sortWithinPartitions("slot", "copy").mapInArrow(_bucket_pairs, "u binary, v binary, bucket long, leader boolean")
        )
        likely = pairs.where("not leader").select("u", "v")
        found = likely if found is None else found.unionByName(likely)
        leaders = pairs.where("leader").select(F.col("u").alias("copy"), "bucket")
        if leaders.isEmpty():
            break
        # the leaders of a large bucket are compared with one of them, and again wherever a further band agrees
        hub = leaders.groupBy("bucket").agg(F.min("copy").alias("v"))
        found = found.unionByName(leaders.join(hub, "bucket").where("copy > v").select(F.col("copy").alias("u"), "v"))
        keyed = (
            leaders.join(texts.select("copy", "keys"), "copy")
            .select("copy", "bucket", F.explode("keys").alias("more"))
            .where("more != bucket")
            .select("copy", F.xxhash64("bucket", "more").alias("bucket"))
        )
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _whole_slots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole slots (rows of a slot are consecutive, ``slot`` is the first column) of at least ``most`` bytes, or what is left."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.nbytes
        if size >= most:
            table = pa.Table.from_batches(kept)
            slot = table.column(0).to_numpy()
            other = np.flatnonzero(slot != slot[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield table.slice(0, cut).combine_chunks()
                kept = table.slice(cut).to_batches()
                size = sum(b.nbytes for b in kept)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _apart(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Likely pairs (one, other, agreement, by row) of a left and a right text of different roots, each in the first bucket that both share.

    Columns: slot, bucket, copy, root, inner, left, keys, tiny. Inner texts are of their bucket's main root. The others stand left and
    right, so of two of them one order is compared.
    """
    slot = table.column("slot").to_numpy()
    rank = pc.rank(table.column("copy"), tiebreaker="dense").to_numpy()
    root = pc.rank(table.column("root"), tiebreaker="dense").to_numpy()
    inner, left = (table.column(c).to_numpy() for c in ("inner", "left"))
    sig = np.frombuffer(b"".join(table.column("tiny").to_pylist()), np.uint8).reshape(len(slot), -1)
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(slot), -1)
    band = np.argmax(keys == table.column("bucket").to_numpy()[:, None], axis=1)
    edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    stop = np.r_[edge[1:], len(slot)]
    which = np.repeat(np.arange(len(edge)), stop - edge)
    lefts = np.flatnonzero(left)
    step = max(1, (1 << 19) // int((stop - edge).max()))
    for a in range(0, len(lefts), step):
        own = lefts[a : a + step]
        of, index = _spread(edge[which[own]], stop[which[own]])
        of = own[of]
        use = ~left[index] & (root[of] != root[index]) & (inner[index] | (rank[of] > rank[index]))
        of, index = of[use], index[use]
        for b in range(0, len(of), 1 << 17):
            i, o = of[b : b + (1 << 17)], index[b : b + (1 << 17)]
            agree = (sig[i] == sig[o]).mean(axis=1)
            likely = agree >= LIKELY
            i, o, agree = i[likely], o[likely], agree[likely]
            new = np.argmax(keys[i] == keys[o], axis=1) == band[i]
            yield i[new], o[new], agree[new]


def _mark_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (slot, copy, left) that stand in a pair of :func:`_apart`: at most as many rows as came in."""
    for table in _whole_slots(batches, 16 << 20):
        seen = np.zeros(len(table), bool)
        for i, o, _ in _apart(table):
            seen[i] = seen[o] = True
        yield from table.select(["slot", "copy", "left"]).filter(pa.array(seen)).to_batches()


def _tile_links(k: int, sketch, n: int, threshold: float):
    """Links (u, v) that join roots, among the pairs of :func:`_apart`, verified on the whole texts that the rows carry.

    The likeliest pairs come first, and a pair whose roots are joined by then is not verified: a tile gives fewer links than it has texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_slots(batches, 16 << 20):
            parts = [(row + s, shingle, count) for s, _, buf, offsets in _small(table.column("text")) for row, shingle, count in [_shingles(buf, offsets, k)]]
            row, shingle, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            weight = count * idf(shingle, sketch.value, n)
            whole = np.bincount(row, weights=weight, minlength=len(table))
            first = np.searchsorted(row, np.arange(len(table) + 1))
            _, number = np.unique(shingle, return_inverse=True)
            width = int(number.max(initial=0)) + 1
            root = pc.rank(table.column("root"), tiebreaker="dense").to_numpy().astype(np.int64)
            joined = np.arange(int(root.max()) + 1)
            u, v = [], []

            def verified(i: np.ndarray, o: np.ndarray) -> np.ndarray:
                sides = []
                for x in (i, o):
                    pair, at = _spread(first[x], first[x + 1])
                    sides.append((pair * width + number[at], at))
                (mine, at1), (theirs, at2) = sides
                spot = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
                both = theirs[spot] == mine if len(theirs) else np.zeros(len(mine), bool)
                low = np.minimum(count[at1[both]], count[at2[spot[both]]]) * (weight[at1[both]] / count[at1[both]])
                shared = np.bincount(mine[both] // width, weights=low, minlength=len(i))
                return shared / np.maximum(whole[i] + whole[o] - shared, 1e-300) >= threshold

            for i, o, agree in _apart(table):
                order = np.argsort(-agree, kind="stable")
                i, o = i[order], o[order]
                step = 256
                while len(i):
                    open_ = joined[root[i]] != joined[root[o]]
                    i, o = i[open_], o[open_]
                    now, i, later, o = i[:step], i[step:], o[:step], o[step:]
                    ok = verified(now, later)
                    for a, b in zip(now[ok].tolist(), later[ok].tolist(), strict=True):
                        x, y = joined[root[a]], joined[root[b]]
                        if x != y:
                            joined[joined == max(x, y)] = min(x, y)
                            u.append(a)
                            v.append(b)
            copies = table.column("copy")
            yield from pa.table({"u": copies.take(pa.array(u, pa.int64())), "v": copies.take(pa.array(v, pa.int64()))}).combine_chunks().to_batches()

    return run


def _joining_links(texts: DataFrame, groups: DataFrame, bodies_of, link) -> DataFrame:
    """Links (u, v) between all groups (node, root) that any likely pair of texts of one bucket joins.

    In each bucket the texts outside its largest group are compared with all texts of other groups, in tiles of bounded size. Texts of
    a likely pair are then brought to the tile, where pairs are verified and what joins two groups comes out.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rooted = texts.select("copy", "keys", "tiny", "bytes").join(groups.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    rooted = materialize(rooted)
    keyed = rooted.select("copy", "root", "bytes", F.explode("keys").alias("bucket"))
    sizes = keyed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    tiles_for = lambda rows, size: F.greatest(F.ceil(rows / CHUNK), F.ceil(size / TILE_BYTES), F.lit(1))
    sizes = sizes.select(
        "bucket",
        F.col("main.root").alias("main"),
        tiles_for(F.col("size") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("across"),
        tiles_for(F.col("size") / 4, F.col("bytes")).alias("down"),
    )
    mine = lambda n: F.sequence(F.pmod(F.xxhash64("copy"), F.col(n)), F.pmod(F.xxhash64("copy"), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tiles = lambda i, j, left: F.flatten(F.transform(i, lambda x: F.transform(j, lambda y: F.struct(x.alias("i"), y.alias("j"), F.lit(left).alias("left")))))
    right, left = tiles(every("across"), mine("down"), False), tiles(mine("across"), every("down"), True)
    mixed = keyed.join(sizes, "bucket").withColumn("inner", F.col("root") == F.col("main"))
    placed = mixed.select("copy", "bucket", "inner", F.inline(F.when(F.col("inner"), right).otherwise(F.concat(right, left))))
    slots = placed.select(F.xxhash64("bucket", "i", "j").alias("slot"), "bucket", "copy", "inner", "left").join(rooted.drop("bytes"), "copy")
    columns = ["slot", "bucket", "copy", "root", "inner", "left", "keys", "tiny"]
    slots = materialize(slots.select(*columns))
    dealt = lambda df: df.repartition(parts, "slot").sortWithinPartitions("slot")
    marked = materialize(dealt(slots).mapInArrow(_mark_apart, "slot long, copy binary, left boolean"))
    if marked.isEmpty():
        return marked.select(F.col("copy").alias("u"), F.col("copy").alias("v"))
    bodies = bodies_of(marked.select("copy"))
    full = slots.join(marked, ["slot", "copy", "left"], "left_semi").join(bodies, "copy").select(*columns, "text")
    return materialize(dealt(full).mapInArrow(link, "u binary, v binary"))


def _similarity(k: int, sketch, n: int):
    """Rows (u, v, text of u, text of v) to (u, v, similarity)."""

    def weighed(texts: pa.Array, a: int, b: int):
        parts = [_shingles(buf, offsets, k) + (s,) for s, _, buf, offsets in _small(texts.slice(a, b - a))]
        row = np.concatenate([p[0] + p[3] for p in parts])
        return row, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for a in range(0, batch.num_rows, 256):
                b = min(batch.num_rows, a + 256)
                sides = [weighed(batch.column(i), a, b) for i in (2, 3)]
                keys = [(row.astype(np.uint64) << np.uint64(64 - _BITS)) | s for row, s, _ in sides]
                weights = [idf(s, sketch.value, n) for _, s, _ in sides]
                at = np.minimum(np.searchsorted(keys[1], keys[0]), max(len(keys[1]) - 1, 0))
                both = keys[1][at] == keys[0] if len(keys[1]) else np.zeros(len(keys[0]), bool)
                low = np.minimum(sides[0][2][both], sides[1][2][at[both]]) * weights[0][both]
                shared = np.bincount(sides[0][0][both], weights=low, minlength=b - a)
                whole = sum(np.bincount(side[0], weights=side[2] * w, minlength=b - a) for side, w in zip(sides, weights))
                value.append(shared / np.maximum(whole - shared, 1e-300))
            similarity = np.concatenate(value) if value else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity, pa.float64())], ["u", "v", "similarity"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, k: int = WORDS
) -> DataFrame:
    """Per row of ``docs``: the id, text_md5 (16 bytes), n_copies (rows with the same text), component (smallest id of its group) and kept (id = component).

    Texts are linked if the weighted Jaccard similarity of their shingles (words of letters and digits, A-Z lower-cased; a text
    of fewer than ``k`` words has one shingle of all its words) is at least ``threshold``; groups are what links connect. Equal texts are one
    group. NULL texts and texts without a word are groups of their own, and so are rows with a NULL id, whose component is NULL
    and which are kept. Rows that repeat an id with one text are both kept or both not. Other columns are not read.

    Copies are merged before any comparison, buckets are compared with their leaders in chunks of bounded size, and
    large buckets are split by further bands, so no group is gathered and no bucket gives all its pairs. Of a group of like texts
    only the links that connect it are looked for.
    """
    spark = docs.sparkSession
    sketch, n = frequency_sketch(docs, text_col, k)
    shared = spark.sparkContext.broadcast(sketch)
    variates = _variates(SAMPLES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in _small(batch.column(2)):
                row, shingle, count = _shingles(buf, offsets, k)
                sig = sample(row, shingle, count * idf(shingle, shared.value, n), b - a, SAMPLES, variates)
                has = np.bincount(row, minlength=b - a) > 0
                values = sig[:, : BANDS * ROWS].reshape(b - a, BANDS, ROWS).astype(np.uint64)
                keys = np.zeros((b - a, BANDS), np.uint64)
                for i in range(ROWS):
                    keys = mix(keys + values[:, :, i] + np.uint64(1))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                tiny = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(has), lists, tiny, pa.array(np.diff(offsets))], ["doc", "copy", "has", "keys", "tiny", "bytes"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).alias("copy"), F.col(text_col).alias("text"))
    scanned = materialize(rows.mapInArrow(scan, f"doc {kind}, copy binary, has boolean, keys array<long>, tiny binary, bytes long"))
    real = scanned.where("has and doc is not null")
    texts = materialize(real.groupBy("copy").agg(F.min("doc").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("tiny").alias("tiny"), F.first("bytes").alias("bytes")))

    def bodies_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.distinct()
        first = texts.join(wanted, "copy", "left_semi").select("copy", F.col("first").alias("doc"))
        return materialize(rows.where("doc is not null").join(first, ["copy", "doc"]).dropDuplicates(["copy"]).select("copy", "text"))

    def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        both = pairs.join(bodies.select(F.col("copy").alias("u"), F.col("text").alias("tu")), "u").join(bodies.select(F.col("copy").alias("v"), F.col("text").alias("tv")), "v")
        links = both.select("u", "v", "tu", "tv").mapInArrow(_similarity(k, shared, n), "u binary, v binary, similarity double").where(F.col("similarity") >= threshold)
        return materialize(links).select("u", "v")

    pairs = materialize(_candidates(texts))
    groups = components(verified(pairs, bodies_of(pairs.select(F.col("u").alias("copy")).union(pairs.select("v")))))
    # leaders and chunks only save work: all likely pairs that they left apart are verified in their tiles
    links = _joining_links(texts, groups, bodies_of, _tile_links(k, shared, n, threshold))
    if not links.isEmpty():
        groups = components(links.unionByName(groups.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    member = texts.select("copy", "first", "n").join(groups.withColumnRenamed("node", "copy"), "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    member = materialize(member)
    lowest = member.groupBy("root").agg(F.min("first").alias("component"))
    classes = member.join(lowest, "root").select("copy", "n", "component")
    out = scanned.select("doc", "copy", (F.col("has") & F.col("doc").isNotNull()).alias("real")).withColumn("_copy", F.when(F.col("real"), F.col("copy")))
    out = out.join(classes.withColumnRenamed("copy", "_copy"), "_copy", "left")
    component = F.when(F.col("real"), F.col("component")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(id_col),
        F.col("copy").alias("text_md5"),
        F.coalesce("n", F.lit(1)).alias("n_copies"),
        component.alias("component"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
    )
