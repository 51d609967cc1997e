"""Readers of sequencing text formats; gzip is transparent everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe import schemas
from seqframe.functions.quality import decode_phred33
from seqframe.functions.scratch import materialize
from seqframe.functions.skew import at_most, lookup_join
from seqframe.sources.lines import MAX_SPLIT_BYTES, MAX_SPLITS, SPLIT, file_name, read_rows, stack_lines, whole_file

# ---------------------------------------------------------------- FASTQ


def _fastq_lines(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """Four-line records with their number in the file: file, read_idx, l0..l3."""
    rows = read_rows(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return stack_lines(rows, 4, parts).withColumnRenamed("record", "read_idx")


def _well_formed() -> Column:
    return F.coalesce(
        F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3")), F.lit(False)
    )


def read_fastq(
    spark: SparkSession, path: str | list[str], sample_id: str | None = None, mate: int = 0, with_file: bool = False, parts: bool = False
) -> DataFrame:
    """Reads of one or many FASTQ files, numbered in file order from 0 in each file.

    With ``parts``, a folder of part files, as Spark writes it, is one file: its parts are read side by side and numbered in name order.

    Without ``sample_id`` the file name up to its first dot names the sample.
    Records that are cut short or malformed are listed by ``malformed_fastq``.
    """
    sample = F.lit(sample_id) if sample_id is not None else F.split_part(file_name(F.col("file")), F.lit("."), F.lit(1))
    return (
        _fastq_lines(spark, path, parts)
        .filter(_well_formed())
        .select(
            sample.alias("sample_id"),
            F.lit(mate).alias("mate"),
            *(["file"] if with_file else []),
            "read_idx",
            F.split_part(F.substr("l0", F.lit(2)), F.lit(" "), F.lit(1)).alias("read_id"),
            F.col("l1").alias("seq"),
            decode_phred33(F.col("l3")).alias("quals"),
        )
    )


def malformed_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, read_idx and reason of every record that is no complete FASTQ record."""
    reason = (
        F.when(F.col("l3").isNull(), "truncated record")
        .when(~F.col("l0").startswith("@"), "header line does not start with @")
        .when(~F.col("l2").startswith("+"), "third line does not start with +")
        .otherwise("sequence and quality differ in length")
    )
    return (
        _fastq_lines(spark, path)
        .filter(~_well_formed())
        .select(file_name(F.col("file")).alias("file"), "read_idx", reason.alias("reason"))
    )


def read_lanes(spark: SparkSession, path: str | list[str], sample_id: str, mate: int, parts: bool = False) -> DataFrame:
    """Reads of the files of one mate with ``lane``, the place of the file in name order, from 0; with ``parts`` a folder of part files is one lane."""
    reads = read_fastq(spark, path, sample_id, mate, with_file=True, parts=parts)
    file = F.col("_metadata.file_path")
    files = spark.read.text(path).select((whole_file(file) if parts else file).alias("file")).distinct()
    # one row a file
    lanes = files.withColumn("lane", F.row_number().over(W.orderBy(file_name(F.col("file")), "file")) - 1)
    return lookup_join(reads, lanes, ["file"], "inner").drop("file")


def read_fastq_pairs(spark: SparkSession, r1: str | list[str], r2: str | list[str], sample_id: str, parts: bool = False) -> DataFrame:
    """Mates 1 and 2 of the records both files have, matched by record order; several files a mate are lanes in name order."""
    both = read_lanes(spark, r1, sample_id, 1, parts).unionByName(read_lanes(spark, r2, sample_id, 2, parts))
    pair = W.partitionBy(*pair_keys(both))
    return both.withColumn("_both", F.min("mate").over(pair) != F.max("mate").over(pair)).filter("_both").drop("_both")


def read_fastq_tree(spark: SparkSession, path: str) -> DataFrame:
    """Reads below ``path`` as :func:`~seqframe.sources.sinks.write_fastq` lays them out: sample, lane, mate and fate come from the folders."""
    level = lambda c: F.regexp_extract("file", f"/{c}=([^/]*)/", 1)
    reads = read_fastq(spark, f"{path}/*/*/*/*", "", with_file=True).drop("sample_id", "mate")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    sample = plain(plain(level("sample_id")))  # the path is a URI of a folder name that is escaped itself
    return reads.select(sample.alias("sample_id"), level("lane").cast("int").alias("lane"), level("mate").cast("int").alias("mate"), level("fate").alias("fate"), "read_id", "seq", "quals")


def pair_keys(reads: DataFrame) -> list[str]:
    """What the mates of a pair share: read_idx counts from 0 in each lane."""
    return ["sample_id", *(["lane"] if "lane" in reads.columns else []), "read_idx"]


def pair_report(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Per sample: records of each mate file, pairs, and whether the files fit."""
    keys = pair_keys(r1)
    one, two = r1.select(*keys, F.lit(1).alias("m1")), r2.select(*keys, F.lit(1).alias("m2"))
    return (
        one.join(two, keys, "full")
        .groupBy("sample_id")
        .agg(
            F.count("m1").alias("n_r1"),
            F.count("m2").alias("n_r2"),
            F.count_if(F.col("m1").isNotNull() & F.col("m2").isNotNull()).alias("n_pairs"),
        )
        .withColumn("equal", F.col("n_r1") == F.col("n_r2"))
    )


# ---------------------------------------------------------------- tables of text columns


def _columns(spark: SparkSession, path: str | list[str], comment: str, least: int) -> DataFrame:
    """Tab-separated rows without blank, comment and short lines, as array ``c``."""
    value = F.regexp_replace("value", r"[\r ]+$", "")
    rows = spark.read.text(path).select(value.alias("value"), F.split(value, "\t").alias("c"))
    return rows.filter((F.trim("value") != "") & ~F.col("value").startswith(comment) & (F.size("c") >= least))


def read_gtf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Annotation features with their attributes as a map (the last of repeated keys wins)."""
    pair = F.lit(r'(\w+)\s+("[^"]*"|[^";]*)\s*;?')  # a quoted value may hold a semicolon
    keys = F.regexp_extract_all(F.get("c", F.lit(8)), pair, F.lit(1))
    values = F.transform(F.regexp_extract_all(F.get("c", F.lit(8)), pair, F.lit(2)), lambda v: F.trim(F.translate(v, '"', "")))
    rows = _columns(spark, path, "#", 9).withColumn("attrs", last_wins(F.arrays_zip(keys.alias("k"), values.alias("v"))))
    return rows.select(
        F.get("c", F.lit(0)).alias("chrom"),
        F.get("c", F.lit(1)).alias("source"),
        F.get("c", F.lit(2)).alias("feature"),
        F.get("c", F.lit(3)).cast("bigint").alias("start_pos"),
        F.get("c", F.lit(4)).cast("bigint").alias("end_pos"),
        F.get("c", F.lit(5)).alias("score"),
        F.get("c", F.lit(6)).alias("strand"),
        F.get("c", F.lit(7)).alias("frame"),
        "attrs",
        F.try_element_at("attrs", F.lit("gene_id")).alias("gene_id"),
        F.try_element_at("attrs", F.lit("transcript_id")).alias("transcript_id"),
    )


def last_wins(pairs: Column) -> Column:
    """Map of (k, v) structs in which the last of repeated keys counts, whatever the session's map policy."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    value = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Regions; an unnamed one is called chrom:start-end with the raw 0-based start."""
    c = [F.get("c", F.lit(i)) for i in range(4)]
    return _columns(spark, path, "#", 3).select(
        c[0].alias("chrom"),
        c[1].cast("bigint").alias("start0"),
        c[2].cast("bigint").alias("end0"),
        F.coalesce(c[3], F.concat(c[0], F.lit(":"), c[1], F.lit("-"), c[2])).alias("name"),
        F.concat(c[0], F.lit(":"), (c[1].cast("bigint") + 1).cast("string"), F.lit("-"), c[2]).alias("region"),
    )


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first eight columns of variant rows."""
    c = [F.get("c", F.lit(i)) for i in range(8)]
    return _columns(spark, path, "#", 8).select(
        c[0].alias("chrom"),
        c[1].cast("bigint").alias("pos"),
        c[3].alias("ref"),
        c[4].alias("alt"),
        c[5].alias("qual"),
        c[6].alias("filter"),
        c[7].alias("info"),
    )


def read_sam(spark: SparkSession, path: str | list[str], sample_id: str | None = None) -> DataFrame:
    """Alignment rows of one or many SAM files with the columns that the alignment operators read; tags keep their type letter out of the value.

    The read group of a row is its RG tag; the sample and the library are those of that group in the header of the same
    file; a folder of part files, as Spark writes it, is one file. Without ``sample_id`` a row of no known group belongs to the sample that the file name up to its first dot names. ``nh`` is
    1 where the tag is absent, ``quals`` NULL where none are stored, ``aln_id`` unique in the table.
    """
    c = [F.get("c", F.lit(i)) for i in range(11)]
    tag = lambda t: F.struct(
        F.substring(t, 1, 2).alias("k"), F.substr(t, F.lit(6)).alias("v")
    )
    tags = F.transform(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), tag)
    value = F.regexp_replace("value", r"[\r ]+$", "")
    lines = read_rows(spark, path).select(whole_file(F.col("file")).alias("file"), "mid", value.alias("value"), F.split(value, "\t").alias("c"))
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("@") & (F.size("c") >= 11))
    rows = rows.withColumn("tags", last_wins(tags)).withColumn("read_group", F.try_element_at("tags", F.lit("RG")))
    field = lambda k: F.nullif(F.regexp_extract("value", f"\t{k}:([^\t]*)", 1), F.lit(""))
    # a header has a row for each lane of a sample
    groups = lines.filter(F.col("value").startswith("@RG")).select("file", field("ID").alias("read_group"), field("SM").alias("_sample"), field("LB").alias("library"))
    groups = groups.groupBy("file", "read_group").agg(F.max("_sample").alias("_sample"), F.max("library").alias("library"))
    placed = lookup_join(rows, materialize(groups), ["file", "read_group"], "left")
    named = F.coalesce("_sample", F.split_part(file_name(F.col("file")), F.lit("."), F.lit(1)))
    return placed.select(
        F.col("mid").alias("aln_id"),
        (F.lit(sample_id) if sample_id is not None else named).alias("sample_id"),
        c[0].alias("qname"),
        c[1].cast("int").alias("flag"),
        c[2].alias("chrom"),
        c[3].cast("bigint").alias("pos"),
        c[4].cast("int").alias("mapq"),
        c[5].alias("cigar"),
        c[6].alias("rnext"),
        c[7].cast("bigint").alias("pnext"),
        c[8].cast("bigint").alias("tlen"),
        c[9].alias("seq"),
        c[10].alias("qual"),
        F.when(c[10] != "*", decode_phred33(c[10])).alias("quals"),
        F.coalesce(F.try_element_at("tags", F.lit("NH")).try_cast("int"), F.lit(1)).alias("nh"),
        "read_group",
        "library",
        "tags",
    )


def read_sam_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, contig_idx (0-based header order), length from the @SQ rows."""
    rows = read_rows(spark, path).filter(F.col("value").startswith("@SQ"))
    found = rows.select(
        F.struct("file", "split", "mid").alias("line"),
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"),
        F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"),
    )
    first = found.groupBy("chrom").agg(F.min("line").alias("line"), F.max("length").alias("length")).select("chrom", "length", "line.*")
    # numbered inside each file split, behind the contigs of the splits before it: one row a split meets in one task
    per_split = first.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("amount"))
    before = W.orderBy(*SPLIT).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_split.select(*SPLIT, F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy(*SPLIT).orderBy("mid")) - 1
    return first.withColumn("nth", nth).join(offsets, SPLIT).select("chrom", (F.col("before") + F.col("nth")).cast("int").alias("contig_idx"), "length")


# ---------------------------------------------------------------- FASTA


def _lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Starts of the stretches of one split, the lines, which of them are headers, and their bases."""
    cut = np.ones(batch.num_rows, bool)
    split, file = batch.column("split").to_numpy(zero_copy_only=False), batch.column("file").to_pylist()
    cut[1:] = (split[1:] != split[:-1]) | np.array([a != b for a, b in pairwise(file)], bool)
    lines = batch.column("value").to_pylist()
    header = np.array([x.startswith(">") for x in lines], bool)
    size = np.where(header, 0, np.array([len(x) for x in lines], np.int64))
    return np.flatnonzero(cut), lines, header, size


def _name(line: str) -> str:
    return (line[1:].split() or [""])[0] if not line[1:2].isspace() else ""


def _fasta_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each file split: the contig open at its end (NULL if none began in it), its bases, and those since that contig began."""
    now, done = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, lines, header, size = _lines_of(batch)
        for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            key = (batch.column("file")[lo].as_py(), batch.column("split")[lo].as_py())
            if now is None or now[0] != key:
                done += [now] if now else []
                now = [key, None, 0, 0]
            heads = np.flatnonzero(header[lo:hi])
            total = int(size[lo:hi].sum())
            now[2] += total
            if len(heads):
                now[1], now[3] = _name(lines[lo + heads[-1]]), int(size[lo + heads[-1] : hi].sum())
            else:
                now[3] += total
    done += [now] if now else []
    cols = [[d[0][0] for d in done], [d[0][1] for d in done], *([d[i] for d in done] for i in (1, 2, 3))]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "split", "open", "total", "tail"])


def _fasta_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contig and offset of every line of bases, from the contig and offset at the start of its split."""
    key, contig, at = None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, lines, header, size = _lines_of(batch)
        chrom, offset = [], []
        edges = np.unique(np.r_[starts, np.flatnonzero(header), batch.num_rows])
        for lo, hi in pairwise(edges.tolist()):  # stretches of one contig in one split
            here = (batch.column("file")[lo].as_py(), batch.column("split")[lo].as_py())
            if here != key:
                key, contig, at = here, batch.column("contig")[lo].as_py(), batch.column("bases")[lo].as_py()
            if header[lo]:
                contig, at = _name(lines[lo]), 0
            upto = np.cumsum(size[lo:hi])
            chrom += [contig] * (hi - lo)
            offset.append(at + upto - size[lo:hi])
            at += int(upto[-1])
        keep = pa.array(size > 0)
        columns = [pa.array(chrom, pa.string()), pa.array(np.concatenate(offset)), batch.column("value")]
        yield pa.record_batch([x.filter(keep) for x in columns], names=["chrom", "offset", "bases"])


def read_fasta(spark: SparkSession, path: str | list[str], chunk: int = 65536, overlap: int = 256) -> DataFrame:
    """Reference bases in chunks: chrom, start0, bases. Chunk k starts at k*chunk and runs ``overlap`` past its end."""
    value = F.regexp_replace("value", r"\s+$", "")
    rows = read_rows(spark, path).withColumn("value", value)
    # per split: the contig open at its end, and the bases since that began
    ends = rows.select(*SPLIT, "value").mapInArrow(_fasta_ends, "file string, split long, open string, total long, tail long")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    upto_split = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("all_upto", F.sum("total").over(upto_split))
    ends = ends.withColumn("mark", F.when(F.col("open").isNotNull(), F.col("all_upto") - F.col("tail")))
    ends = ends.select(
        *SPLIT,
        F.last("open", True).over(before).alias("contig"),
        F.coalesce(F.col("all_upto") - F.col("total") - F.last("mark", True).over(before), F.lit(0)).alias("bases"),
    )
    ends = materialize(ends)
    if not at_most(ends, MAX_SPLITS, MAX_SPLIT_BYTES):
        raise ValueError("too many file splits for their table to be handed to every task; use larger ones")
    opened = rows.join(F.broadcast(ends), SPLIT).select(*SPLIT, "contig", "bases", "value")
    placed = opened.mapInArrow(_fasta_places, "chrom string, offset long, bases string").withColumn("size", F.length("bases").cast("long"))
    # cut each line at chunk borders and put the pieces of a chunk together (a group of fixed size)
    first = F.greatest(F.lit(0), F.expr(f"(offset - {overlap} + {chunk} - 1) div {chunk} - 1"))
    last = F.expr(f"(offset + size - 1) div {chunk}")
    pieces = placed.withColumn("k", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    lo = F.greatest(F.col("offset"), F.col("k") * chunk)
    hi = F.least(F.col("offset") + F.col("size"), (F.col("k") + 1) * chunk + overlap)
    pieces = pieces.withColumns({"lo": lo, "n": hi - lo}).filter("n > 0")
    piece = F.substring(F.col("bases"), (F.col("lo") - F.col("offset") + 1).cast("int"), F.col("n").cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("lo", piece.alias("text"))))
    return (
        pieces.groupBy("chrom", "k")
        .agg(parts.alias("parts"))
        .select(
            "chrom",
            (F.col("k") * chunk).alias("start0"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("bases"),
        )
    )


# ---------------------------------------------------------------- sheets, matrices, results


def _require(columns: Sequence[str], needed: Sequence[str], what: str) -> None:
    missing = [c for c in needed if c not in columns]
    if missing:
        raise ValueError(f"{what} must include {', '.join(missing)}")


def _header(spark: SparkSession, path: str, sep: str, comment: str = "#") -> list[str]:
    """Column names of a delimited file (reads its first data row only)."""
    reader = spark.read.option("header", True).option("sep", sep).option("comment", comment)
    return reader.option("inferSchema", False).csv(path).columns


def read_sample_sheet(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text; absent optional columns come back NULL."""
    sep = sep or ("\t" if path.endswith((".tsv", ".txt")) else ",")
    names = _header(spark, path, sep)
    _require(names, ["sample_id"], "sample sheet")
    raw = spark.read.option("header", True).option("sep", sep).csv(path, schema=", ".join(f"`{n}` string" for n in names))
    known = [f.name for f in schemas.SAMPLES.fields]
    given = [F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in known]
    return raw.select(*given, *[n for n in names if n not in known])


# Descriptive columns of a count table that hold no counts.
DESCRIPTIVE = ("Chr", "Start", "End", "Strand", "Length")


def read_count_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Wide genes x samples text to long gene_id, sample_id, cnt."""
    names = _header(spark, path, sep)
    samples = [n for n in names[1:] if n not in DESCRIPTIVE]
    ddl = ", ".join(f"`{n}` {'double' if n in samples else 'string'}" for n in names)
    wide = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path, schema=ddl)
    wide = wide.select(F.col(f"`{names[0]}`").alias("gene_id"), *[F.col(f"`{s}`") for s in samples])
    long = wide.unpivot("gene_id", [F.col(f"`{s}`") for s in samples], "sample_id", "cnt")
    return long.select("gene_id", "sample_id", F.bround("cnt").cast("bigint").alias("cnt"))


def read_de_results(spark: SparkSession, path: str) -> DataFrame:
    """Differential expression results; gene, padj and log2FoldChange are required, NA is NULL."""
    names = _header(spark, path, ",")
    _require(names, ["gene", "padj", "log2FoldChange"], "DE results")
    types = {f.name: f.dataType.simpleString() for f in schemas.DE_RESULTS.fields}
    ddl = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return spark.read.option("header", True).option("nullValue", "NA").csv(path, schema=ddl)


def read_gene_sets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """User tables that stand in for an annotation database: kind terms, edges, idmap or genes."""
    layout = {
        "terms": "gene string, term string",
        "edges": "child string, parent string",
        "idmap": "symbol string, entrez int",
        "genes": "gene string",
    }
    if kind not in layout:
        raise ValueError(f"unknown gene set table {kind}")
    needed = [c.split()[0] for c in layout[kind].split(", ")]
    if path.rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(path)
        _require(table.columns, needed, f"{kind} table")
        return table.select(*needed)
    names = _header(spark, path, ",")
    _require(names, needed, f"{kind} table")
    types = dict(c.split() for c in layout[kind].split(", "))
    ddl = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return spark.read.option("header", True).csv(path, schema=ddl).select(*needed)


# ---------------------------------------------------------------- tool reports


def _report_path(path: Column) -> Column:
    """Folder and file names of a report, outermost first.

    A report may also be a folder of part files, as Spark leaves it; then the
    folder is the report and a ``column=`` prefix of its name is dropped.
    """
    names = F.transform(F.split(path, "/"), lambda n: F.regexp_replace(n, r"^\w+=", ""))
    is_part = F.element_at(names, -1).startswith("part-")
    return F.when(is_part, F.slice(names, F.lit(1), F.size(names) - 1)).otherwise(names)


#: What stands before the name of each report but the first of a file of collected reports.
NEXT_REPORT = "\n==> "


def _collected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file and value of every line of reports collected in few text files, as ``tail -n +1`` prints them.

    Each report follows a line ``==> name <==``. A report is one record of the scan, so a file of many is cut like any other.
    """
    records = spark.read.option("lineSep", NEXT_REPORT).text(path)
    name = F.regexp_extract("value", r"^(?:==> )?([^\n]+?) <==\r?(?:\n|$)", 1)
    lines = F.split(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\r?\n")
    return records.select(name.alias("file"), F.explode(lines).alias("value")).filter(F.col("file") != "")


def _reports(spark: SparkSession, path: str, name: str, collected: bool) -> DataFrame:
    """sample_id (folder name without a report suffix) and value of all reports called ``name``."""
    if collected:
        rows = _collected(spark, path).filter(F.col("file").endswith(name))
    else:
        rows = spark.read.text(f"{path}/*/*{name}").select(F.col("_metadata.file_path").alias("file"), "value")
    folder = F.try_element_at(_report_path(F.col("file")), F.lit(-2))
    return rows.select(F.regexp_replace(folder, r"_fastqc$", "").alias("sample_id"), "value")


def read_qc_reports(spark: SparkSession, path: str, collected: bool = False) -> DataFrame:
    """sample_id, module, status from every summary.txt in the folders (one per sample) of ``path``, or of those ``collected`` in text files."""
    c = F.split("value", "\t")
    rows = _reports(spark, path, "summary.txt", collected)
    rows = rows.select("sample_id", F.get(c, F.lit(1)).alias("module"), F.get(c, F.lit(0)).alias("status"))
    return rows.filter(F.col("status").isin("PASS", "WARN", "FAIL"))


def read_qc_lengths(spark: SparkSession, path: str, collected: bool = False) -> DataFrame:
    """sample_id, read_length (upper bound, NULL if absent) from every fastqc_data.txt."""
    upper = F.regexp_extract("value", r"^Sequence length\t(?:\d+-)?(\d+)$", 1)
    rows = _reports(spark, path, "fastqc_data.txt", collected)
    return rows.groupBy("sample_id").agg(F.max(F.nullif(upper, F.lit("")).cast("int")).alias("read_length"))


def read_aligner_logs(spark: SparkSession, path: str, collected: bool = False) -> DataFrame:
    """sample_id (log name up to its first dot) and mapping_rate; 0.0 where a log names none.

    Files of many samples are dear to list: logs ``collected`` in few text files, as ``tail -n +1 *.log`` prints them, are read in one scan.
    """
    pattern = r"([0-9]+(?:\.[0-9]+)?)% overall alignment rate"
    rate = F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast("double")
    lines = _collected(spark, path) if collected else spark.read.text(f"{path}/*").select(F.col("_metadata.file_path").alias("file"), "value")
    name = F.element_at(_report_path(F.col("file")), -1)
    rows = lines.select(F.split_part(name, F.lit("."), F.lit(1)).alias("sample_id"), rate.alias("rate"))
    return rows.groupBy("sample_id").agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("mapping_rate"))
