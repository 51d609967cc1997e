"""Sample sheets: validation and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted experiment types and organisms.
EXPERIMENTS = ("RNA-Seq", "WGS", "WES")
ORGANISMS = ("human", "mouse", "rat", "zebrafish", "yeast", "other", "mixed")


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column) == "", F.lit(True))


def duplicate_samples(samples: DataFrame) -> DataFrame:
    """sample_id and n of every id that occurs more than once; a blank id counts as a value."""
    ids = samples.select(F.coalesce("sample_id", F.lit("")).alias("sample_id"))
    return ids.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate_samples(
    samples: DataFrame,
    paired: bool,
    experiment: str = "RNA-Seq",
    organism: str = "human",
    gtf: str | None = None,
    reference_fasta: str | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """row_no, sample_id, rule, message for every violation; run-level ones have row_no 0.

    ``samples`` must carry ``row_no`` (1-based). ``paths`` lists the files that exist.
    """
    spark: SparkSession = samples.sparkSession
    row = F.col("row_no")
    rules: list[tuple[str, Column, Column]] = [
        ("sample_id", _blank("sample_id"), F.format_string("row %d has no sample_id", row))
    ]
    if paired:
        wrong = _blank("fastq_r1") | _blank("fastq_r2")
        rules.append(("fastq", wrong, F.format_string("row %d lacks a file of its read pair", row)))
    else:
        rules.append(("fastq", _blank("fastq"), F.format_string("row %d names no FASTQ file", row)))
    found = [
        F.when(wrong, F.struct(F.lit(rule).alias("rule"), message.alias("message"))) for rule, wrong, message in rules
    ]
    out = samples.select("row_no", "sample_id", F.inline(F.array_compact(F.array(*found))))

    repeated = duplicate_samples(samples).select(
        F.lit(0).cast("bigint").alias("row_no"),
        "sample_id",
        F.lit("duplicate").alias("rule"),
        F.format_string("%d rows are named %s", "n", "sample_id").alias("message"),
    )
    out = out.unionByName(repeated)

    if paths is not None:
        columns = ("fastq_r1", "fastq_r2") if paired else ("fastq",)
        listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("path")) for c in columns])
        wanted = samples.select("row_no", "sample_id", F.inline(listed)).filter(~_blank("path"))
        absent = wanted.join(paths.select("path").distinct(), "path", "left_anti")
        message = F.format_string("row %d: nothing to read at %s, %s", "row_no", "column", "path")
        out = out.unionByName(absent.select("row_no", "sample_id", F.lit("path").alias("rule"), message.alias("message")))

    run_level = []
    if experiment not in EXPERIMENTS:
        run_level.append(("experiment", f"unknown experiment type {experiment}"))
    if organism not in ORGANISMS:
        run_level.append(("organism", f"unknown organism {organism}"))
    if experiment == "RNA-Seq" and not gtf:
        run_level.append(("gtf", "an RNA run needs gene features (gtf)"))
    if experiment in ("WGS", "WES") and not reference_fasta:
        run_level.append(("reference_fasta", "a DNA run needs a reference sequence (reference_fasta)"))
    if run_level:
        rows = [(0, None, rule, message) for rule, message in run_level]
        out = out.unionByName(spark.createDataFrame(rows, "row_no bigint, sample_id string, rule string, message string"))
    empty = samples.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return out.unionByName(
        empty.select(
            F.lit(0).cast("bigint").alias("row_no"),
            F.lit(None).cast("string").alias("sample_id"),
            F.lit("empty").alias("rule"),
            F.lit("the sheet holds no sample").alias("message"),
        )
    )


def fill_sample_defaults(samples: DataFrame, run_id: str, organism: str) -> DataFrame:
    """Missing condition, replicate group and species filled; ``sample_run_id`` added."""
    filled = samples.withColumns(
        {
            "condition": F.coalesce("condition", F.lit("unknown")),
            "replicate_group": F.coalesce("replicate_group", F.lit("")),
            "species": F.coalesce("species", F.lit(organism)),
        }
    )
    return filled.withColumn("sample_run_id", F.concat_ws("-", F.lit(run_id), F.coalesce("sample_id", F.lit(""))))


def single_sample(spark: SparkSession, fastq: str | None = None, fastq_r1: str | None = None, fastq_r2: str | None = None) -> DataFrame:
    """The sheet of a run that names its files directly."""
    schema = "sample_id string, condition string, replicate_group string, species string, fastq string, fastq_r1 string, fastq_r2 string"
    return spark.createDataFrame([("sample-01", "unknown", None, None, fastq, fastq_r1, fastq_r2)], schema)
