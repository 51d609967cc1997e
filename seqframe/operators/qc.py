"""Read quality control as aggregations.

Two small tables carry most modules: the *base profile* (sample, position, base,
quality -> count) and the *read profile* (sample, length, mean quality, GC % ->
count). Both are combined on the map side, so what is shuffled depends on read
length and quality range, not on the number of reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.functions.skew import lookup_join

# Public adapter sequences searched for by default.
ADAPTERS = {
    "Illumina Universal Adapter": "AGATCGGAAGAG",
    "Illumina Small RNA 3' Adapter": "TGGAATTCTCGG",
    "Illumina Small RNA 5' Adapter": "GATCGTCGGACT",
    "Nextera Transposase Sequence": "CTGTCTCTTATA",
}

# Module names as users know them from QC reports.
BASIC = "Basic Statistics"
BASE_QUALITY = "Per base sequence quality"
READ_QUALITY = "Per sequence quality scores"
BASE_CONTENT = "Per base sequence content"
READ_GC = "Per sequence GC content"
BASE_N = "Per base N content"
READ_LENGTH = "Sequence Length Distribution"
DUPLICATION = "Sequence Duplication Levels"
OVERREPRESENTED = "Overrepresented sequences"
ADAPTER = "Adapter Content"


@dataclass(frozen=True)
class Limits:
    """Module thresholds, each as (warn, fail)."""

    lower_quartile: tuple[float, float] = (10, 5)
    median: tuple[float, float] = (25, 20)
    mode_quality: tuple[float, float] = (27, 20)
    base_gap: tuple[float, float] = (10, 20)
    gc_deviation: tuple[float, float] = (15, 30)
    n_content: tuple[float, float] = (5, 20)
    duplicated: tuple[float, float] = (20, 50)
    overrepresented: tuple[float, float] = (0.1, 1)
    adapter: tuple[float, float] = (5, 10)
    #: positions seen in this many reads or fewer do not count for base quality; all count unless asked otherwise
    min_reads: int = 0


def _above(value: Column, limits: tuple[float, float]) -> Column:
    warn, fail = limits
    return F.when(value > fail, "FAIL").when(value > warn, "WARN").otherwise("PASS")


def _letters(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def read_count(reads: DataFrame) -> DataFrame:
    """Reads per sample; for pairs the smaller of the two mate counts."""
    per_mate = reads.groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("n"))
    return per_mate.groupBy("sample_id").agg(
        F.min("n").alias("n_reads"), (F.count(F.lit(1)) > 1).alias("paired")
    )


#: Bases that a task counts at a time.
BASES_AT_ONCE = 1 << 20


def _count_bases():
    """Batches of sample_id, seq and quals to counts by sample, position, quality and base of up to ``BASES_AT_ONCE`` bases."""
    names = ["sample_id", "pos", "q", "n", "n_a", "n_c", "n_g", "n_t", "n_n"]
    most = BASES_AT_ONCE
    code = np.full(128, 5)
    code[[ord(b) for b in "ACGTN"]] = range(5)

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Qualities (and which of them are there) of all lists, one after the other."""
        values = lists.flatten()
        return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(values).to_numpy(zero_copy_only=False)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        samples = part.column(0).dictionary_encode()
        sample = pc.fill_null(samples.indices, len(samples.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = part.column(1).to_pylist()
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        bases = np.array([len(t) for t in texts], np.int64)
        q, there = flat(part.column(2))
        given = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.maximum(bases, given)  # the shorter of both ends in NULLs
        row = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(row)) - (np.cumsum(size) - size)[row]

        def at(length: np.ndarray, values: np.ndarray, missing) -> np.ndarray:
            out = np.full(len(row), missing, values.dtype)
            out[pos < length[row]] = values
            return out

        base = at(bases, np.where(letters < 128, code[np.minimum(letters, 127)], 5), 5)
        low, high = (int(q[there].min()), int(q[there].max())) if there.any() else (0, 0)
        level = np.where(at(given, there, False), at(given, q - low, 0), high - low + 1)
        levels, places = high - low + 2, int(size.max(initial=0))
        key = (sample[row] * places + pos) * levels + level
        cells = (len(samples.dictionary) + 1) * places * levels
        if cells <= 4 * most:
            keys = np.arange(cells)
        else:  # a few very long reads, or qualities far apart
            keys, key = np.unique(key, return_inverse=True)
        n = np.bincount(key * 6 + base, minlength=6 * len(keys)).reshape(-1, 6)
        seen = np.flatnonzero(n.any(axis=1))
        keys, n = keys[seen], n[seen]
        q_of = keys % levels
        columns = [samples.dictionary.take(pa.array(keys // levels // max(places, 1), mask=keys // levels // max(places, 1) == len(samples.dictionary)))]
        columns += [pa.array((keys // levels % max(places, 1) + 1).astype(np.int32)), pa.array((q_of + low).astype(np.int32), mask=q_of == levels - 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.sum(axis=1)), *[pa.array(n[:, k]) for k in range(5)]], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.maximum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                yield count(batch.slice(at, to - at))
                at = to

    return run


def base_profile(reads: DataFrame) -> DataFrame:
    """sample_id, pos (1-based), q -> bases seen and how many are A, C, G, T, N.

    Tasks count the bases of a batch of reads before Spark adds the counts up, so no row is made for a base.
    """
    sums = ["n", *[f"n_{b}" for b in "acgtn"]]
    whole = reads.filter(F.col("seq").isNotNull() & F.col("quals").isNotNull())
    rows = whole.select("sample_id", "seq", F.col("quals").cast("array<int>").alias("quals"))
    parts = rows.mapInArrow(_count_bases(), "sample_id string, pos int, q int, " + ", ".join(f"{c} long" for c in sums))
    return parts.groupBy("sample_id", "pos", "q").agg(*[F.sum(c).alias(c) for c in sums])


def read_profile(reads: DataFrame, quality: bool = True) -> DataFrame:
    """sample_id, length, mean quality (rounded down), GC % (nearest) -> reads, GC bases.

    Without ``quality`` there is no mean quality, and the qualities are not read.
    """
    size = F.length("seq")
    called = _letters(F.col("seq"), "ACGT")
    gc = _letters(F.col("seq"), "GC")
    per_read = reads.select(
        "sample_id",
        size.alias("length"),
        gc.alias("gc"),
        called.alias("called"),
        *([F.aggregate("quals", F.lit(0), lambda a, q: a + q).alias("qsum")] if quality else []),
    )
    return per_read.groupBy(
        "sample_id",
        "length",
        *([F.expr("case when length > 0 then cast(qsum div length as int) end").alias("mean_q")] if quality else []),
        F.expr("case when called > 0 then cast((200 * gc + called) div (2 * called) as int) end").alias("gc_pct"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("gc").alias("gc"), F.sum("called").alias("called"))


def basic_stats(profile: DataFrame) -> DataFrame:
    """Reads, length range and label, read length (the upper bound) and % GC, from a read profile."""
    return (
        profile.groupBy("sample_id")
        .agg(
            F.sum("n").alias("n_reads"),
            F.min("length").alias("min_length"),
            F.max("length").alias("max_length"),
            F.round(100.0 * F.sum("gc") / F.nullif(F.sum("called"), F.lit(0)), 4).alias("pct_gc"),
        )
        .withColumn(
            "length_label",
            F.when(F.col("min_length") == F.col("max_length"), F.col("min_length").cast("string")).otherwise(
                F.concat_ws("-", "min_length", "max_length")
            ),
        )
        .withColumn("read_length", F.col("max_length"))
    )


def per_base_quality(profile: DataFrame) -> DataFrame:
    """Mean, median, quartiles and 10/90 % quality per position (nearest rank), from a base profile."""
    at_pos = W.partitionBy("sample_id", "pos")
    ranked = profile.withColumn("cum", F.sum("n").over(at_pos.orderBy("q"))).withColumn("total", F.sum("n").over(at_pos))

    def rank(percent: int) -> Column:
        return F.min(F.when(F.col("cum") * 100 >= F.col("total") * percent, F.col("q")))

    return ranked.groupBy("sample_id", "pos").agg(
        F.max("total").alias("n_reads"),
        F.round(F.sum(F.col("q") * F.col("n")) / F.max("total"), 4).alias("mean"),
        rank(50).alias("median"),
        rank(25).alias("lower_quartile"),
        rank(75).alias("upper_quartile"),
        rank(10).alias("p10"),
        rank(90).alias("p90"),
    )


def per_sequence_quality(profile: DataFrame) -> DataFrame:
    """Histogram of the mean quality of reads."""
    return (
        profile.filter(F.col("mean_q").isNotNull())
        .groupBy("sample_id", "mean_q")
        .agg(F.sum("n").alias("n_reads"))
    )


def _content(profile: DataFrame) -> DataFrame:
    counts = profile.groupBy("sample_id", "pos").agg(*[F.sum(c).alias(c) for c in ("n", *[f"n_{b}" for b in "acgtn"])])
    called = F.nullif(F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t"), F.lit(0))
    return counts.select(
        "sample_id",
        "pos",
        *[F.round(100.0 * F.col(f"n_{b}") / called, 4).alias(f"pct_{b}") for b in "acgt"],
        F.round(100.0 * F.col("n_n") / F.col("n"), 4).alias("pct_n"),
    )


def per_base_content(profile: DataFrame) -> DataFrame:
    """% A, C, G, T among called bases at each position, from a base profile."""
    return _content(profile).drop("pct_n")


def per_base_n(profile: DataFrame) -> DataFrame:
    """% of uncalled bases (N) at each position, from a base profile."""
    return _content(profile).select("sample_id", "pos", "pct_n")


def _gc_sums(gc: Column, n: Column) -> list[Column]:
    """Aggregates (at most 101 counts per sample) that the GC curve is fitted from."""
    entry = F.when(gc.isNotNull(), F.struct(gc.alias("gc_pct"), n.alias("n_reads")))
    return [
        F.map_from_entries(F.collect_list(entry)).alias("gc_hist"),
        F.max(F.when(gc.isNotNull(), F.struct(n.alias("n"), (-gc).alias("minus_gc")))).alias("gc_top"),
        F.sum(F.when(gc.isNotNull(), n)).alias("gc_total"),
        F.sum(gc * n).alias("gc_s1"),
        F.sum(gc * gc * n).alias("gc_s2"),
    ]


def _fit_gc(sums: DataFrame) -> DataFrame:
    """Add ``gc_rows``: observed and expected reads for each GC %, around the most common one."""
    mode, total = F.col("gc_mode"), F.col("gc_total")
    spread = F.col("gc_s2") - 2 * mode * F.col("gc_s1") + mode * mode * total
    fitted = sums.withColumn("gc_mode", -F.col("gc_top.minus_gc")).withColumn(
        "gc_sd", F.nullif(F.when(total > 1, F.sqrt(spread / F.nullif(total - 1, F.lit(0)))), F.lit(0.0))
    )

    def weight(g: Column) -> Column:
        z = (g - mode) / F.col("gc_sd")
        return F.coalesce(F.exp(-z * z / 2), (g == mode).cast("double"))

    grid = F.sequence(F.lit(0), F.lit(100))
    weighted = fitted.withColumn("gc_w", F.transform(grid, weight)).withColumn(
        "gc_w_sum", F.aggregate("gc_w", F.lit(0.0), lambda a, x: a + x)
    )
    rows = F.transform(
        grid,
        lambda g: F.struct(
            g.alias("gc_pct"),
            F.coalesce(F.try_element_at("gc_hist", g), F.lit(0)).alias("n_reads"),
            F.round(F.get("gc_w", g) / F.col("gc_w_sum") * total, 4).alias("expected"),
        ),
    )
    return weighted.withColumn("gc_rows", rows)


def per_sequence_gc(profile: DataFrame) -> DataFrame:
    """Reads per GC % (0..100) next to a normal curve around the most common GC %."""
    observed = profile.filter("gc_pct is not null").groupBy("sample_id", "gc_pct").agg(F.sum("n").alias("n"))
    sums = observed.groupBy("sample_id").agg(*_gc_sums(F.col("gc_pct"), F.col("n")))
    return _fit_gc(sums).select("sample_id", F.inline("gc_rows"))


def length_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy("sample_id", "length").agg(F.sum("n").alias("n_reads"))


def sequence_counts(reads: DataFrame) -> DataFrame:
    """Copies of each sequence per sample; combined on the map side, so a very common one is no hot key."""
    return reads.groupBy("sample_id", "seq").agg(F.count(F.lit(1)).alias("copies"))


# Lower bounds of the duplication levels above nine copies.
LEVELS = (10, 50, 100, 500, 1000, 5000, 10000)


def _level(copies: Column) -> Column:
    level = F.when(copies > LEVELS[-1], f">{LEVELS[-1]}")
    for bound in reversed(LEVELS[:-1]):
        level = level.when(copies > bound, f">{bound}")
    return level.when(copies == LEVELS[0], f">{LEVELS[0] - 1}").otherwise(copies.cast("string"))


def duplication_levels(seq_counts: DataFrame) -> DataFrame:
    """Distinct sequences and reads per number of copies (1..9, >9, >10, >50, ...)."""
    return seq_counts.groupBy("sample_id", _level(F.col("copies")).alias("level")).agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("copies").alias("n_reads")
    )


def _pct_duplicated() -> Column:
    total = F.sum("copies")
    return F.round(100.0 * (total - F.count(F.lit(1))) / total, 4)


def _top_share() -> Column:
    return 100.0 * F.max("copies") / F.sum("copies")


def duplication_rate(seq_counts: DataFrame) -> DataFrame:
    """% of reads that would be removed by keeping one read per sequence."""
    return seq_counts.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("copies").alias("n_reads"),
        _pct_duplicated().alias("pct_duplicated"),
    )


def sample_totals(reads: DataFrame) -> DataFrame:
    """sample_id, total: a scan of one column."""
    return reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))


def overrepresented_sequences(seq_counts: DataFrame, totals: DataFrame, min_percent: float = 0.1) -> DataFrame:
    """Sequences that make up more than ``min_percent`` % of a sample with ``totals`` reads."""
    share = 100.0 * F.col("copies") / F.col("total")
    return (
        lookup_join(seq_counts, totals, ["sample_id"], "inner")
        .filter(share > min_percent)
        .select("sample_id", "seq", "copies", F.round(share, 4).alias("percent"))
    )


def adapter_content(reads: DataFrame, adapters: Mapping[str, str] = ADAPTERS) -> DataFrame:
    """Cumulative % of reads whose first adapter match starts at or before each position."""
    starts = F.array(
        *[F.struct(F.lit(n).alias("adapter"), F.instr("seq", a).alias("pos")) for n, a in adapters.items()]
    )
    totals = sample_totals(reads)
    hits = (
        reads.select("sample_id", F.explode(F.filter(starts, lambda s: s["pos"] > 0)).alias("h"))
        .groupBy("sample_id", "h.adapter", "h.pos")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = W.partitionBy("sample_id", "adapter").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return (
        hits.withColumn("cum", F.sum("n").over(upto))
        .join(totals, "sample_id")
        .select("sample_id", "adapter", "pos", F.round(100.0 * F.col("cum") / F.col("total"), 4).alias("cum_percent"))
    )


def _read_sums() -> Column:
    """Called bases, G and C, and the sum of qualities of each read, a batch of reads at a time."""
    called, gc = (np.isin(np.arange(256), list(letters)).astype(np.int64) for letters in (b"ACGT", b"GC"))

    def sums(seq: pa.Array, quals: pa.Array) -> pa.Array:
        def within(values: np.ndarray, length: pa.Array) -> np.ndarray:
            end = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
            total = np.r_[0, np.cumsum(values)]
            return total[end] - total[np.r_[0, end[:-1]]]

        text, size = np.frombuffer("".join(t or "" for t in seq.to_pylist()).encode(), np.uint8), pc.binary_length(seq)
        none, q, sizes = pc.is_null(seq).to_numpy(zero_copy_only=False), quals.flatten(), pc.list_value_length(quals)
        gaps = within(pc.is_null(q).to_numpy(zero_copy_only=False).astype(np.int64), sizes) > 0
        qsum = within(pc.fill_null(q, 0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        unknown = gaps | pc.is_null(quals).to_numpy(zero_copy_only=False)
        columns = [pa.array(within(called[text], size), mask=none), pa.array(within(gc[text], size), mask=none), pa.array(qsum, mask=unknown)]
        return pa.StructArray.from_arrays(columns, ["called", "gc", "qsum"])

    return F.arrow_udf(sums, "called long, gc long, qsum long")(F.col("seq"), F.col("quals").cast("array<int>"))


def read_numbers(reads: DataFrame, adapters: Mapping[str, str]) -> DataFrame:
    """Histograms of everything known from one read alone, in one scan: sample_id, kind, value -> n."""
    size = F.length("seq")
    called, gc, qsum = F.col("sums.called"), F.col("sums.gc"), F.col("sums.qsum")
    facts = {
        "length": size,
        "mean_q": F.floor(qsum / F.nullif(size, F.lit(0))).cast("int"),
        "gc_pct": F.floor((200 * gc + called) / F.nullif(2 * called, F.lit(0))).cast("int"),
        **{f"adapter {name}": F.nullif(F.instr("seq", a), F.lit(0)) for name, a in adapters.items()},
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in facts.items()])
    return (
        reads.select("sample_id", "seq", _read_sums().alias("sums"))
        .select("sample_id", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("sample_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _of_reads(histograms: DataFrame, adapters: Mapping[str, str]) -> DataFrame:
    """One row per sample of everything the read-level modules judge."""
    value, n = F.col("value"), F.col("n")

    def of(kind: str, column: Column) -> Column:
        return F.when(F.col("kind") == kind, column)

    hits = [F.sum(of(f"adapter {name}", n)) for name in adapters]
    most_hits = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(h, F.lit(0)) for h in hits])
    sums = histograms.groupBy("sample_id").agg(
        F.min(of("length", value)).alias("len_min"),
        F.max(of("length", value)).alias("len_max"),
        (-F.max(of("mean_q", F.struct("n", (-value).alias("v"))))["v"]).alias("mode_q"),
        F.round(100.0 * most_hits / F.sum(of("length", n)), 4).alias("adapter"),
        *_gc_sums(of("gc_pct", value), n),
    )
    off = F.aggregate("gc_rows", F.lit(0.0), lambda a, r: a + F.abs(r["n_reads"] - r["expected"]))
    return _fit_gc(sums).select(
        "sample_id", "len_min", "len_max", "mode_q", "adapter", (100.0 * off / F.col("gc_total")).alias("gc_off")
    )


def _of_bases(profile: DataFrame, limits: Limits) -> DataFrame:
    """One row per sample of everything the base-level modules judge, along one chain of shuffles."""
    at_pos = W.partitionBy("sample_id", "pos")
    n, total, cum = F.col("n"), F.col("total"), F.col("cum")
    ranked = profile.withColumn("cum", F.sum("n").over(at_pos.orderBy("q"))).withColumn("total", F.sum("n").over(at_pos))
    per_pos = ranked.groupBy("sample_id", "pos").agg(
        F.max("total").alias("total"),
        F.min(F.when(cum * 100 >= total * 25, F.col("q"))).alias("lq"),
        F.min(F.when(cum * 100 >= total * 50, F.col("q"))).alias("med"),
        *[F.sum(f"n_{b}").alias(f"n_{b}") for b in "acgtn"],
    )
    called = F.nullif(F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t"), F.lit(0))
    pct = {b: F.round(100.0 * F.col(f"n_{b}") / called, 4) for b in "acgt"}
    gap = F.greatest(F.abs(pct["a"] - pct["t"]), F.abs(pct["g"] - pct["c"]))
    lq, med = F.col("lq"), F.col("med")
    worst = (
        F.when(F.col("total") <= limits.min_reads, 0)
        .when((lq < limits.lower_quartile[1]) | (med < limits.median[1]), 2)
        .when((lq < limits.lower_quartile[0]) | (med < limits.median[0]), 1)
        .otherwise(0)
    )
    return per_pos.groupBy("sample_id").agg(
        F.max(worst).alias("quality"),
        F.max(gap).alias("gap"),
        F.max(F.round(100.0 * F.col("n_n") / F.col("total"), 4)).alias("n_pct"),
    )


def qc_flags(reads: DataFrame, limits: Limits = Limits(), adapters: Mapping[str, str] = ADAPTERS) -> DataFrame:
    """PASS, WARN or FAIL per sample and module.

    Three scans of the reads (bases, reads, sequences), each reduced to one row
    per sample before the rows of a sample meet.
    """
    of_seqs = (
        sequence_counts(reads).groupBy("sample_id").agg(_pct_duplicated().alias("dup"), _top_share().alias("top_share"))
    )
    numbers = [_of_reads(read_numbers(reads, adapters), adapters), _of_bases(base_profile(reads), limits), of_seqs]
    wide = numbers[0].join(numbers[1], "sample_id", "left").join(numbers[2], "sample_id", "left")
    value = {c: F.col(c) for c in ("mode_q", "gap", "gc_off", "n_pct", "len_min", "len_max", "dup", "top_share")}
    status = {
        BASIC: F.lit("PASS"),
        BASE_QUALITY: _above(F.coalesce("quality", F.lit(0)), (0, 1)),
        READ_QUALITY: F.when(value["mode_q"] < limits.mode_quality[1], "FAIL")
        .when(value["mode_q"] < limits.mode_quality[0], "WARN")
        .otherwise("PASS"),
        BASE_CONTENT: _above(value["gap"], limits.base_gap),
        READ_GC: _above(value["gc_off"], limits.gc_deviation),
        BASE_N: _above(value["n_pct"], limits.n_content),
        READ_LENGTH: F.when(value["len_min"] == 0, "FAIL")
        .when(value["len_min"] != value["len_max"], "WARN")
        .otherwise("PASS"),
        DUPLICATION: _above(value["dup"], limits.duplicated),
        OVERREPRESENTED: _above(value["top_share"], limits.overrepresented),
        ADAPTER: _above(F.coalesce("adapter", F.lit(0.0)), limits.adapter),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("module"), s.alias("status")) for m, s in status.items()])
    return wide.select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")


def qc_summary(
    stats: DataFrame,
    flags: DataFrame,
    *,
    duplication: DataFrame | None = None,
    mapping: DataFrame | None = None,
    assigned: DataFrame | None = None,
    depth: DataFrame | None = None,
    modules: Sequence[str] = (BASE_QUALITY, BASE_CONTENT, ADAPTER),
) -> DataFrame:
    """One row per sample over every table a run has; a sample missing in a table gets NULLs there."""
    counts = flags.groupBy("sample_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")],
        *[
            F.max(F.when(F.col("module") == m, F.col("status"))).alias(m.lower().replace(" ", "_"))
            for m in modules
        ],
    )
    out = stats.join(counts, "sample_id", "full")
    for table in (duplication, mapping, assigned, depth):
        if table is not None:
            out = out.join(table, "sample_id", "full")
    return out
