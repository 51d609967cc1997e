"""Writers. Every one writes a folder in parallel; nothing is brought to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.quality import encode_phred33
from seqframe.functions.scratch import discard, materialize
from seqframe.operators.alignments import linear_index

#: Folder of the linear index below stored alignments.
INDEX = "_index"


def _fastq_text(reads: DataFrame):
    quals = encode_phred33(F.col("quals"))
    return F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), quals).alias("value")


FASTQ_LEVELS = {"sample_id": "unknown", "lane": 0, "mate": 0, "fate": "all"}


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip", partitions: int | None = None) -> None:
    """Records in read order, in one folder ``sample_id=/lane=/mate=/fate=`` each; a column that ``reads`` lacks has one value there.

    One job, range-partitioned by folder and read: a large sample is spread over part files, whose name order is the order of
    the records, and samples of any number are written side by side. Records are made and stored before they are dealt: they are shorter
    than their arrays of qualities, and finding the ranges reads them once more.
    """
    levels = {c: F.coalesce(F.col(c).cast("string"), F.lit(str(v))) if c in reads.columns else F.lit(str(v)) for c, v in FASTQ_LEVELS.items()}
    order = [*FASTQ_LEVELS, "read_idx", "read_id"]
    rows = reads.select("read_idx", "read_id", _fastq_text(reads), *[c.alias(k) for k, c in levels.items()])
    records = materialize(rows)
    rows = records.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    text = rows.select("value", *FASTQ_LEVELS)
    text.write.mode("overwrite").option("compression", compression).partitionBy(*FASTQ_LEVELS).text(path)
    discard(records)


def write_fastq_pairs(fated: DataFrame, path: str, compression: str = "gzip") -> None:
    """Reads marked by ``split_pairs`` in folders of sample, lane, mate and fate (paired or unpaired), in one job."""
    write_fastq(fated, path, compression)


def write_alignments(alignments: DataFrame, path: str) -> None:
    """Coordinate-sorted Parquet by contig, and below it a linear index that bounds where the reads of a region begin.

    Row-group statistics find the rows from there. Readers of the table don't see the index, as its name begins with ``_``.
    """
    keys = ["chrom", "pos"]
    ordered = alignments.repartitionByRange(*keys, "qname").sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").partitionBy("chrom").parquet(path)
    stored = alignments.sparkSession.read.schema(alignments.schema).parquet(path)
    linear_index(stored).repartitionByRange("chrom", "window").write.mode("overwrite").parquet(f"{path}/{INDEX}")


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored alignments and their linear index."""
    return spark.read.parquet(path), spark.read.parquet(f"{path}/{INDEX}")


def write_vcf(calls: DataFrame, contigs: DataFrame, path: str, compression: str = "none") -> None:
    """VCF text of each sample in the folder ``sample_id=``: header first, then sites in contig order, all alternatives of a site in one row.

    ``calls`` as :func:`~seqframe.operators.pileup.call_variants` gives them; ``contigs`` has chrom and contig_idx. One job,
    range-partitioned, so the part files of a sample in name order are its VCF. The calls are stored before: the header, the rows
    and the ranges are each found from them.
    """
    calls, contigs = materialize(calls), materialize(contigs.select("chrom", "contig_idx"))
    ads = F.sort_array(F.collect_list(F.struct("alt", F.col("ad_alt").cast("string").alias("ad"))))  # one to three alternatives
    sites = calls.groupBy("sample_id", "chrom", "pos", "ref", "alts", "qual", "gt", "dp", "ad_ref").agg(ads.alias("a"))
    sites = sites.join(contigs, "chrom", "left")
    depth = F.concat_ws(",", F.col("ad_ref").cast("string"), F.col("a.ad"))
    columns = ["chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alts", F.format_string("%.2f", F.round("qual", 2)), F.lit("PASS"), F.concat(F.lit("DP="), "dp"), F.lit("GT:DP:AD")]
    rows = sites.select("sample_id", F.coalesce("contig_idx", F.lit(2147483647)).alias("k"), "chrom", "pos", F.concat_ws("\t", *columns, F.concat_ws(":", "gt", F.col("dp").cast("string"), depth)).alias("value"))
    names = F.concat_ws("\t", F.lit("#CHROM"), *[F.lit(c) for c in ("POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")], "sample_id")
    lines = [
        "##fileformat=VCFv4.2",
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
        '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Reads of each allele">',
    ]
    head = calls.select("sample_id").distinct().select("sample_id", F.posexplode(F.array(*[F.lit(x) for x in lines], names)).alias("pos", "value"))
    head = head.select("sample_id", F.lit(-1).alias("k"), F.lit("").alias("chrom"), F.col("pos").cast("long").alias("pos"), "value")
    order = ["sample_id", "k", "chrom", "pos", "value"]
    text = head.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("sample_id", "value")
    text.write.mode("overwrite").option("compression", compression).partitionBy("sample_id").text(path)


def widen_counts(counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Long counts to genes x samples; the sample list is given, so no extra pass finds it."""
    return counts.groupBy("gene_id").pivot("sample_id", list(samples)).agg(F.first("cnt"))


def write_count_matrix(counts: DataFrame, path: str, samples: Sequence[str]) -> None:
    wide = widen_counts(counts, samples)
    wide.na.fill(0).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_assignment_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_table_csv(table: DataFrame, path: str, null: str = "NA") -> None:
    """variants.csv, coverage_depth.csv, deseq_results.csv, go_enrichment.csv: header, no index."""
    table.write.mode("overwrite").option("header", True).option("nullValue", null).option("emptyValue", "").csv(path)


def write_run(table: DataFrame, base: str, run_id: str, stage: str) -> None:
    """Stage output in the folder base/stage=<stage>/run_id=<run_id>; a rerun replaces its own folder only, also by no rows."""
    table.drop("run_id").write.mode("overwrite").parquet(f"{base}/stage={stage}/run_id={run_id}")


def write_summary_json(record: DataFrame, path: str) -> None:
    """One JSON line per run."""
    record.write.mode("overwrite").json(path)


def write_collected(reports: DataFrame, path: str) -> None:
    """Many short reports (name, value) as few text files, one after the other as ``tail -n +1`` prints them."""
    text = F.concat(F.lit("==> "), "name", F.lit(" <==\n"), "value", F.lit("\n"))
    reports.select(text.alias("value")).write.mode("overwrite").text(path)
