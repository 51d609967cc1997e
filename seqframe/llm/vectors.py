"""Near-duplicate embeddings by tiled comparison in PCA order.

Vectors are turned so that the directions of largest variance come first, and cut into tiles by label and first
coordinate. Two tiles are multiplied a few dimensions at a time; what the other dimensions can still add is bounded by the norms of the
rest, and a pair, or a whole tile pair, is left as soon as its cosine cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm.graph import components

THRESHOLD = 0.93

#: Vectors in a tile and dimensions in a step.
TILE, STEP = 1024, 16

#: Leading coordinates whose ranges a tile carries, and different vector lengths a table may hold (a d x d basis each).
LEAD, MAX_DIMS = 8, 64

#: Cosines this close to the threshold are computed again from the given numbers.
_NEAR = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine and keeps squares finite."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The rows of each vector length."""
    lengths = np.diff(np.asarray(batch.column(at).offsets)) if batch.num_rows else np.zeros(0, int)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        part = batch.take(pa.array(rows))
        yield dim, _matrix(part.column(at), dim), part


def _bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the directions of the unit vectors by falling second moment, as columns."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x, _ in _by_dim(batch, 0):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            for i in range(dim):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim), "i": pa.array([i] * dim), "j": pa.array(range(dim)), "v": pa.array(m[i])})

    rows = vectors.select("embedding").mapInArrow(moments, "dim long, i long, j long, v double")
    dims = [r["dim"] for r in rows.select("dim").distinct().limit(MAX_DIMS + 1).collect()]
    if len(dims) > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} different vector lengths")
    out = {d: np.zeros((d, d)) for d in dims}
    for r in rows.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["dim"]][r["i"], r["j"]] = r["v"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in out.items()}


def _tiles(bases, tile: int):
    """Rows (label, dim, first, rep, n, embedding) in that order to one row a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
            dim = batch.column(1)[0].as_py()
            x = _matrix(batch.column(5), dim)
            turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ bases.value[dim]
            lead = turned[:, :LEAD]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(0, 1), batch.column(1).slice(0, 1), pa.array([batch.column(3)[0].as_py()])]
                + [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (lead.min(axis=0), lead.max(axis=0))]
                + [pa.array([batch.column(i).to_pylist()], pa.list_(pa.int64())) for i in (3, 4)]
                + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())],
                ["label", "dim", "tile", "lo", "hi", "reps", "ns", "data"],
            )

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            label = np.array([str(v) for v in table.column(0).to_pylist()])
            dims = table.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (dims[1:] != dims[:-1]), True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for s in range(a, b, tile):
                    e = min(b, s + tile)
                    if e == len(table) and not last and e - s < tile:
                        kept.extend(table.slice(s).to_batches())
                    else:
                        yield emit(table.slice(s, e - s).combine_chunks().to_batches()[0])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                if sum(b.num_rows for b in kept) >= 4 * tile:
                    yield from cut(False)
        if kept:
            yield from cut(True)

    return run


def _compare(bases, threshold: float):
    """Tile pairs to (rep, links, root): direct links of each vector found here, and the smallest vector it is linked to here."""

    def pairs(x: np.ndarray, y: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        ux, uy = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        a, b = ux @ bases.value[dim], uy @ bases.value[dim]
        rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
        ra, rb = rest(a), rest(b)
        i = j = None
        dot = np.zeros((len(a), len(b)))
        for s in range(0, dim, STEP):
            e = min(dim, s + STEP)
            if i is None:
                dot += a[:, s:e] @ b[:, s:e].T
                if e == dim:
                    bound = dot
                else:
                    bound = dot + ra[:, e, None] * rb[None, :, e]
                alive = bound >= threshold - _NEAR
                n = int(alive.sum())
                if not n:
                    return np.zeros(0, int), np.zeros(0, int)
                if n * 16 < alive.size or e == dim:
                    i, j = np.nonzero(alive)
                    dot = dot[i, j]
            else:
                dot = dot + np.einsum("ij,ij->i", a[i, s:e], b[j, s:e])
                bound = dot if e == dim else dot + ra[i, e] * rb[j, e]
                alive = bound >= threshold - _NEAR
                i, j, dot = i[alive], j[alive], dot[alive]
        edge = np.abs(dot - threshold) <= _NEAR
        if edge.any():
            p, q = x[i[edge]], y[j[edge]]
            dot[edge] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
        return i[dot >= threshold], j[dot >= threshold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, ra, na, da, rb, nb, db, same = (batch.column(c)[k].as_py() for c in range(8))
                x, y = (np.frombuffer(d, np.float64).reshape(-1, dim) for d in (da, db))
                i, j = pairs(x, y, dim)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                reps = np.array(ra + ([] if same else rb))
                ns = np.array(na + ([] if same else nb))
                j = j if same else j + len(ra)
                links = np.bincount(i, weights=ns[j], minlength=len(reps)) + np.bincount(j, weights=ns[i], minlength=len(reps))
                low = reps.copy()
                while True:  # smallest vector reached, along links and then along what was reached
                    new = low.copy()
                    np.minimum.at(new, i, low[j])
                    np.minimum.at(new, j, low[i])
                    if (new == low).all():
                        break
                    low = new
                used = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(reps[used]), pa.array(links[used].astype(np.int64)), pa.array(low[used])], ["rep", "links", "root"])

    return run


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """Per row of ``table``: the id, n_links (other rows linked directly), component_id (smallest id that links reach) and kept.

    Rows are linked if their labels are equal, their vectors equally long and the cosine, in double precision, is at least
    ``threshold``. Without a link, and with itself as component, is a row whose label is NULL or whose vector is NULL, empty, zero
    or holds a NULL or non-finite number. A row without an id links with nothing and has no component; it is kept. Rows that
    repeat an id count as rows. Ties need no rule: all links count. Other columns are not read.

    Equal vectors of a label are merged first, so a vector copied any number of times is compared once. Each tile pair returns at most
    two rows a vector: sums and the smallest vector reached, never the pairs themselves. Tiles whose ranges
    of leading coordinates are too far apart never meet.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall("embedding", lambda v: v == 0)
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & ~zero
    rows = rows.select("id", "label", F.when(F.coalesce(ok, F.lit(False)), F.col("embedding")).alias("embedding")).withColumns(
        {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding"), "ok": F.col("embedding").isNotNull()}
    )
    keys = ["label", "h1", "h2"]
    classes = materialize(
        rows.where("ok").groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    )
    bases = spark.sparkContext.broadcast(_bases(classes))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, x, part in _by_dim(batch, 3):
                lead = (x @ bases.value[dim][:, 0]) / np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([dim] * len(x), pa.int64()), pa.array(lead), part.column(1), part.column(2), part.column(3)],
                    ["label", "dim", "first", "rep", "n", "embedding"],
                )

    ordered = classes.select("label", "rep", "n", "embedding").mapInArrow(first, "label string, dim long, first double, rep long, n long, embedding array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "label", "dim", "first").sortWithinPartitions("label", "dim", "first", "rep")
    tiles = materialize(
        ordered.mapInArrow(_tiles(bases, tile), "label string, dim long, tile long, lo array<double>, hi array<double>, reps array<long>, ns array<long>, data binary")
    )
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)  # distance of unit vectors at the threshold
    cell = lambda c: F.floor(F.col(c)[0] / F.lit(reach))
    box = tiles.select("label", "dim", "tile", "lo", "hi")
    left = box.select("label", "dim", F.col("tile").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("cell"))
    right = box.select("label", "dim", F.col("tile").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    gap = F.expr("aggregate(sequence(0, size(la) - 1), 0d, (s, i) -> s + pow(greatest(0d, lb[i] - ha[i], la[i] - hb[i]), 2))")
    meet = left.join(right, ["label", "dim", "cell"]).where("a <= b").where(gap <= reach * reach).select("a", "b").distinct()
    meet = materialize(meet)
    sides = [tiles.select(F.col("tile").alias(k), "dim", F.col("reps").alias(f"r{k}"), F.col("ns").alias(f"n{k}"), F.col("data").alias(f"d{k}")) for k in "ab"]
    both = meet.join(sides[0], "a").join(sides[1].drop("dim"), "b")
    both = both.repartition(parts, "a", "b").select("dim", "ra", "na", "da", "rb", "nb", "db", (F.col("a") == F.col("b")).alias("same"))
    found = materialize(both.mapInArrow(_compare(bases, threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    classes = classes.select(*keys, "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    classes = classes.select(*keys, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("id", "ok", *keys).join(classes.withColumn("ok", F.lit(True)), ["ok", *keys], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
