"""Order statistics that never sort one whole group in one task.

The building block is a running total over *distinct values*: rows are first
counted per value (map-side), values fall into fixed, order-preserving buckets,
a window runs inside each bucket, and the short table of bucket totals carries
the offset from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.functions.skew import lookup_join


def float_bucket(value: Column, per_octave: int = 256) -> Column:
    """Order-preserving bucket of a double: finer near zero, ~0.3 % wide elsewhere."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * per_octave) + 997 * per_octave
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * size).cast("bigint")


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, amount: str, bucket: Column, out: str = "running"
) -> DataFrame:
    """Add the inclusive running total of ``amount`` by ``order`` within ``keys``.

    ``(keys, order)`` must be unique in ``df`` and ``bucket`` must not decrease
    with ``order``.
    """
    keys = list(keys)
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(F.sum(amount).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("_r", F.sum(amount).over(inside))
    return ranked.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_rows"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of ``value`` per ``keys`` (mean of the two middle rows if even)."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    ranked = running_total(counts, keys, value, "n_rows", float_bucket(F.col(value)))
    totals = counts.groupBy(*keys).agg(F.sum("n_rows").alias("_n"))
    last, n = F.col("running"), F.col("_n")
    first = last - F.col("n_rows") + 1
    low, high = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    return (
        ranked.join(totals, keys)
        .groupBy(*keys)
        .agg(
            F.max(F.when((first <= low) & (low <= last), F.col(value))).alias("_lo"),
            F.max(F.when((first <= high) & (high <= last), F.col(value))).alias("_hi"),
        )
        .select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))
    )


def bh_adjust(df: DataFrame, p: str = "pvalue", by: Sequence[str] = (), out: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within ``by``; a NULL p stays NULL and is not counted.

    ``df`` is stored first unless :func:`materialize` gave it: its p-values are joined with themselves, and sums of doubles that
    are computed twice may differ in their last digit.
    """
    by = list(by)
    scope = by or ["_all"]
    df = df if getattr(df, "_scratch_path", None) else materialize(df)
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = value_counts(rows, scope, p)
    bucket = float_bucket(F.col(p))
    totals = counts.groupBy(*scope).agg(F.sum("n_rows").alias("_n"))
    raw = (
        running_total(counts, scope, p, "n_rows", bucket)
        .join(totals, scope)
        .select(*scope, p, (F.col(p) * F.col("_n") / F.col("running")).alias("_q"), bucket.alias("_b"))
    )
    bucket_min = raw.groupBy(*scope, "_b").agg(F.min("_q").alias("_m"))
    later = W.partitionBy(*scope).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = bucket_min.select(*scope, "_b", F.min("_m").over(later).alias("_c"))
    inside = W.partitionBy(*scope, "_b").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    adjusted = (
        raw.withColumn("_q", F.min("_q").over(inside))
        .join(carried, [*scope, "_b"])
        .select(*scope, p, F.least(F.lit(1.0), "_q", "_c").alias(out))
    )
    return lookup_join(rows, adjusted, [*scope, p], "left", count_first=False).drop("_all")
