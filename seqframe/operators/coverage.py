"""Sequencing depth as runs of equal depth, and panel coverage on top of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.operators.alignments import DUPLICATE, QC_FAIL, SECONDARY, UNMAPPED, alignment_blocks, none_of
from seqframe.operators.counts import for_each_sample, sample_table
from seqframe.operators.intervals import overlap_join

DEPTH_EXCLUDE = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
SWEEP_BIN = 65536


def depth(alignments: DataFrame, exclude: int = DEPTH_EXCLUDE) -> DataFrame:
    """Maximal runs of equal, non-zero depth: sample_id, chrom, start_pos, end_pos, depth.

    Every aligned stretch adds +1 at its start and -1 after its end. The changes
    are summed per position on the map side; a running sum inside position bins
    and one over the short table of bin totals give the depth, so neither a long
    chromosome nor a deep locus lands in one task.
    """
    keys = ["sample_id", "chrom"]
    blocks = alignment_blocks(alignments.filter(none_of(exclude)), gap_ops="ND", keep=keys)
    edge = F.inline(
        F.array(
            F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("step")),
            F.struct((F.col("end_pos") + 1).alias("pos"), F.lit(-1).alias("step")),
        )
    )
    changes = (
        blocks.select(*keys, edge)
        .groupBy(*keys, "pos")
        .agg(F.sum("step").alias("step"))
        .filter("step <> 0")
        .withColumn("bin", F.expr(f"pos div {SWEEP_BIN}"))
    )
    along = W.partitionBy(*keys).orderBy("bin")
    carried = (
        changes.groupBy(*keys, "bin")
        .agg(F.sum("step").alias("step"), F.min("pos").alias("first"))
        .select(
            *keys,
            "bin",
            F.coalesce(F.sum("step").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lead("first").over(along).alias("next_first"),
        )
    )
    inside = W.partitionBy(*keys, "bin").orderBy("pos")
    swept = changes.withColumns(
        {
            "inner": F.sum("step").over(inside.rowsBetween(W.unboundedPreceding, 0)),
            "next_pos": F.lead("pos").over(inside),
        }
    )
    return (
        swept.join(carried, [*keys, "bin"])
        .select(
            *keys,
            F.col("pos").alias("start_pos"),
            (F.coalesce("next_pos", "next_first") - 1).alias("end_pos"),
            (F.col("before") + F.col("inner")).alias("depth"),
        )
        .filter("depth > 0")
    )


def region_mean_depth(
    runs: DataFrame, regions: DataFrame, samples: DataFrame | Sequence[str] | None = None, include_zero: bool = False
) -> DataFrame:
    """Mean depth of each BED line and sample over its covered positions (0.0 if none).

    ``include_zero`` divides by the region length instead.
    """
    names = sample_table(samples, runs)
    region = ["chrom", "start0", "end0", "name"]
    # an unnamed line is told by its place
    regions = regions.withColumn("name", F.coalesce("name", F.format_string("%s:%d-%d", "chrom", "start0", "end0")))
    lookup = regions.select(*region).distinct()
    spans = lookup.withColumns({"start_pos": F.col("start0") + 1, "end_pos": F.col("end0")})
    size = F.least("end_pos", "lk_end") - F.greatest("start_pos", "lk_start") + 1
    sums = (
        overlap_join(runs, spans)
        .groupBy("sample_id", *region)
        .agg(F.sum(size * F.col("depth")).alias("bases"), F.sum(size).alias("covered"))
    )
    lines = for_each_sample(regions.select(*region), names)
    width = F.col("end0") - F.col("start0") if include_zero else F.col("covered")
    return lines.join(sums, ["sample_id", *region], "left").select(
        "sample_id",
        F.col("name").alias("gene"),
        F.format_string("%s:%d-%d", F.col("chrom"), F.col("start0") + 1, F.col("end0")).alias("region"),
        F.coalesce(F.round(F.col("bases") / F.nullif(width, F.lit(0)), 4), F.lit(0.0)).alias("mean_depth"),
    )


def panel_mean_depth(coverage: DataFrame) -> DataFrame:
    """Unweighted mean of the region means per sample; values that are no numbers are left out."""
    value = F.col("mean_depth").cast("string").try_cast("double")
    return coverage.groupBy("sample_id").agg(F.avg(value).alias("mean_depth"))
