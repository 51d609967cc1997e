"""Operators over the alignments table (SAM columns plus sample_id)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions import cigar as cg
from seqframe.functions.skew import lookup_join

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(bits: int) -> Column:
    """All of ``bits`` are set."""
    return F.col("flag").bitwiseAND(bits) == bits


def none_of(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) == 0


def mapping_rate(alignments: DataFrame, digits: int | None = 2) -> DataFrame:
    """% of primary reads that are mapped, per sample."""
    primary = alignments.filter(none_of(SECONDARY | SUPPLEMENTARY))
    rate = 100.0 * F.count_if(none_of(UNMAPPED)) / F.count(F.lit(1))
    return primary.groupBy("sample_id").agg((rate if digits is None else F.round(rate, digits)).alias("mapping_rate"))


def flagstat(alignments: DataFrame) -> DataFrame:
    """Alignment counts by flag, split into QC-passed and QC-failed, per sample: one aggregation."""
    primary = none_of(SECONDARY | SUPPLEMENTARY)
    paired = primary & has(PAIRED)
    both = paired & none_of(UNMAPPED | MATE_UNMAPPED)
    elsewhere = both & (F.col("rnext") != "=") & (F.col("rnext") != F.col("chrom")) & (F.col("rnext") != "*")
    counts = {
        "total": F.lit(True),
        "n_primary": primary,
        "secondary": has(SECONDARY),
        "supplementary": has(SUPPLEMENTARY),
        "duplicates": has(DUPLICATE),
        "primary_duplicates": primary & has(DUPLICATE),
        "mapped": none_of(UNMAPPED),
        "primary_mapped": primary & none_of(UNMAPPED),
        "paired": paired,
        "read1": paired & has(READ1),
        "read2": paired & has(READ2),
        "properly_paired": paired & has(PROPER) & none_of(UNMAPPED),
        "both_mapped": both,
        "singletons": paired & none_of(UNMAPPED) & has(MATE_UNMAPPED),
        "mate_elsewhere": elsewhere,
        "mate_elsewhere_mapq5": elsewhere & (F.col("mapq") >= 5),
    }
    return alignments.groupBy("sample_id", F.when(none_of(QC_FAIL), "passed").otherwise("failed").alias("qc")).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()]
    )


def coordinate_sort(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Range-partitioned by header contig order and position; reads without a place come last."""
    order = contigs.select("chrom", F.col("contig_idx").alias("_idx"))
    keyed = lookup_join(alignments, order, ["chrom"], "left").withColumn(
        "contig_idx", F.when(has(UNMAPPED), F.lit(2147483647)).otherwise(F.coalesce("_idx", F.lit(2147483647)))
    )
    keys = ["contig_idx", "pos", "qname"]
    return keyed.drop("_idx").repartitionByRange(*keys).sortWithinPartitions(*keys)


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """``chrom`` or ``chrom:start-end`` (1-based, closed)."""
    hit = re.fullmatch(r"(.+?):([\d,]+)-([\d,]+)", region)
    if not hit:
        return region, None, None
    return hit[1], int(hit[2].replace(",", "")), int(hit[3].replace(",", ""))


#: Positions in a window of the linear index.
INDEX_WINDOW = 16_384


def linear_index(alignments: DataFrame) -> DataFrame:
    """chrom, window, first_pos: the least start of the mapped reads that reach into each window of positions. One additive aggregate."""
    spans = alignments.filter(none_of(UNMAPPED)).select("chrom", "pos", (F.col("pos") + F.greatest(cg.reference_length(F.col("cigar")), F.lit(1)) - 1).alias("last"))
    window = F.explode(F.expr(f"sequence(pos div {INDEX_WINDOW}, last div {INDEX_WINDOW})"))
    return spans.select("chrom", "pos", window.alias("window")).groupBy("chrom", "window").agg(F.min("pos").alias("first_pos"))


def first_start(index: DataFrame, region: str) -> int | None:
    """The least start of a read that reaches into the region's windows (a look into a stored index), None if there is no such read."""
    chrom, start, end = parse_region(region)
    rows = index.filter(F.col("chrom") == chrom)
    if start is not None:
        rows = rows.filter(F.col("window").between(start // INDEX_WINDOW, end // INDEX_WINDOW))
    return rows.agg(F.min("first_pos")).first()[0]


def view(
    alignments: DataFrame, region: str | None = None, require: int = 0, exclude: int = 0, min_mapq: int = 0, index: DataFrame | None = None
) -> DataFrame:
    """Flag, mapping quality and region filter; plain predicates, so they reach the scan.

    With the table's ``index`` both ends of a region bound the starts that are read: without it a long gapped read may begin anywhere
    before the region. Unmapped reads are viewed by their place as long as they are no index's concern, so leave it out for them.
    """
    out = alignments
    if region is not None:
        chrom, start, end = parse_region(region)
        out = out.filter(F.col("chrom") == chrom)
        if start is not None:
            # the exact test needs the CIGAR; the others prune row groups
            if index is not None:
                lowest = first_start(index, region)
                out = out.filter(none_of(UNMAPPED)).filter(F.col("pos") >= F.lit(end + 1 if lowest is None else lowest).cast("bigint"))
            out = out.filter(F.col("pos") <= end).filter(F.col("pos") + cg.reference_length(F.col("cigar")) - 1 >= start)
    if require:
        out = out.filter(has(require))
    if exclude:
        out = out.filter(none_of(exclude))
    return out.filter(F.col("mapq") >= min_mapq) if min_mapq else out


def alignment_blocks(alignments: DataFrame, gap_ops: str = "N", keep: Sequence[str] = ("aln_id", "sample_id", "chrom")) -> DataFrame:
    """One row per aligned stretch of each mapped read: start_pos, end_pos (closed, 1-based)."""
    mapped = alignments.filter(none_of(UNMAPPED))
    return mapped.select(*keep, F.inline(cg.blocks(F.col("pos"), F.col("cigar"), gap_ops)))


def _fragments(alignments: DataFrame, score: Column) -> DataFrame:
    """One row per sequenced fragment: its outermost ends and its score."""
    end = F.struct(
        F.col("chrom"),
        cg.unclipped_five_prime(F.col("pos"), F.col("cigar"), F.col("flag")).alias("five_prime"),
        has(REVERSE).alias("reverse"),
    )
    examined = alignments.filter(none_of(UNMAPPED | SECONDARY | SUPPLEMENTARY))
    return examined.groupBy("sample_id", "library", "qname").agg(
        F.min(end).alias("first_end"),
        F.max(end).alias("last_end"),
        F.sum(score).alias("score"),
    )


def base_quality_score(quals: Column, floor: int = 15) -> Column:
    return F.aggregate(F.filter(quals, lambda q: q >= floor), F.lit(0).cast("bigint"), lambda a, q: a + q)


def kept_fragments(alignments: DataFrame, score: Column | None = None) -> DataFrame:
    """sample_id, library, qname of the best fragment of each position (highest score, then name).

    Found by aggregation alone, so a position that holds a large part of all
    reads is no hot task.
    """
    score = base_quality_score(F.col("quals")) if score is None else score
    best = (
        _fragments(alignments, score)
        .groupBy("sample_id", "library", "first_end", "last_end")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("qname"))).alias("best"))
    )
    return best.select("sample_id", "library", F.col("best.qname").alias("qname"))


def mark_duplicates(alignments: DataFrame, score: Column | None = None) -> DataFrame:
    """Set 0x400 on the primary alignments of fragments that repeat a better one and clear it elsewhere.

    Reads without a library are of one library of their own.
    """
    keys = ["sample_id", "library", "qname"]
    named = {f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys}  # no name holds that
    kept = kept_fragments(alignments, score).select(*[c.alias(k) for k, c in named.items()], F.lit(True).alias("_kept"))
    cleared = F.col("flag").bitwiseAND(~DUPLICATE)
    repeats = F.col("_kept").isNull() & none_of(UNMAPPED | SECONDARY | SUPPLEMENTARY)
    return (
        alignments.withColumns(named)
        .join(kept, list(named), "left")
        .withColumn("flag", F.when(repeats, cleared.bitwiseOR(DUPLICATE)).otherwise(cleared))
        .drop("_kept", *named)
    )


def library_size(examined: Column, distinct: Column, steps: int = 60) -> Column:
    """Size x of a library with ``distinct`` = x (1 - exp(-examined / x)), by bisection; NULL without duplicates."""
    n, c = examined.cast("double"), distinct.cast("double")

    def too_small(m: Column) -> Column:
        x = m * c
        return c / x - 1 + F.exp(-n / x) > 0

    start = F.struct(F.lit(1.0).alias("lo"), F.lit(1e6).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.struct(
            F.when(too_small(mid), mid).otherwise(acc["lo"]).alias("lo"),
            F.when(too_small(mid), acc["hi"]).otherwise(mid).alias("hi"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when((c > 0) & (n > c), F.floor(c * found))


def duplication_metrics(marked: DataFrame) -> DataFrame:
    """Reads examined, duplicates, their share and the estimated library size, per sample and library."""
    examined = marked.filter(none_of(UNMAPPED | SECONDARY | SUPPLEMENTARY))
    counts = examined.groupBy("sample_id", "library").agg(
        F.count(F.lit(1)).alias("examined"), F.count_if(has(DUPLICATE)).alias("duplicates")
    )
    n, d = F.col("examined"), F.col("duplicates")
    return counts.select(
        "sample_id",
        "library",
        n,
        d,
        F.round(100.0 * d / n, 4).alias("pct_duplicates"),
        library_size(n, n - d).alias("library_size"),
    )
