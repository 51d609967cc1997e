"""Plan shapes that matter at scale."""

import re

from pyspark.sql import functions as F

from seqframe.functions.skew import lookup_join
from seqframe.operators import alignments as al
from seqframe.operators import counts as ct
from seqframe.operators import coverage as cv
from seqframe.operators import mapping, recalibrate, trim, variants
from seqframe.plans import catalog  # noqa: F401
from seqframe.plans.registry import QUERIES, Views
from seqframe.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_view_prunes_the_scan(spark, tmp_path):
    sinks.write_alignments(Views(spark, SF)("alignments"), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    text = plan(al.view(stored, "chr2:5,000-30,000", min_mapq=10).select("qname", "pos"))
    assert "PartitionFilters: [isnotnull(chrom" in text and "LessThanOrEqual(pos,30000)" in text
    assert "pnext" not in text and "library" not in text
    stored, index = sinks.read_alignments(spark, str(tmp_path))
    text = plan(al.view(stored, "chr2:20,000-30,000", index=index).select("qname", "pos"))
    low = int(re.search(r"PushedFilters: [^\n]*GreaterThanOrEqual\(pos,(\d+)\)", text)[1])
    assert 19_000 < low <= 20_000 - 20_000 % al.INDEX_WINDOW + al.INDEX_WINDOW and "LessThanOrEqual(pos,30000)" in text


def test_trimming_needs_no_shuffle(spark, tmp_path):
    Views(spark, SF)("reads").write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    assert "Exchange" not in plan(trim.trim_reads(reads))


def test_trimming_takes_the_window_apart_once_a_read(spark):
    reads = spark.createDataFrame([("S", 1, 0, "r", "ACGT", [30, 30, 2, 2])], "sample_id string, mate int, read_idx bigint, read_id string, seq string, quals array<int>")
    params = spark.createDataFrame([("S", 3, 3, "4:20", 36)], "sample_id string, leading_q int, trailing_q int, sliding string, min_len int")
    text = trim.trim_reads(reads, params)._jdf.queryExecution().optimizedPlan().toString()
    searches = [line for line in text.splitlines() if "aggregate(" in line]
    assert searches and not any("sliding" in line for line in searches)


def test_no_nested_loops_or_cross_products_in_interval_work(spark):
    v = Views(spark, SF)
    rows = v("alignments")
    for df in (ct.assign_reads(rows, v("exons")), cv.region_mean_depth(cv.depth(rows), v("panel"), ["S1"])):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_lookup_that_is_no_broadcast_is_not_made_one_by_a_guess(spark):
    lookup = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    fact = spark.range(10_000).select((F.col("id") % 2000).alias("k"), "id")
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = lookup_join(fact, lookup, ["k"], how, broadcast_rows=10)
        assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
        assert joined.count() == {"inner": 5000, "left": 10_000, "left_semi": 5000, "left_anti": 5000}[how]
    assert "Broadcast" not in plan(ct.for_each_sample(lookup, spark.createDataFrame([("S1",), ("S2",)], "sample_id string")))


def test_flagstat_is_one_shuffle(spark):
    text = plan(al.flagstat(Views(spark, SF)("alignments").filter(F.col("mapq") > 0)))
    # the aggregation's own exchange and the one that spreads the single test file
    assert text.count("Exchange") <= 2


def test_reading_fastq_shuffles_only_cut_records(spark, tmp_path):
    reads = Views(spark, SF)("reads").limit(2000)
    sinks.write_fastq(reads, str(tmp_path), compression="none")
    text = plan(readers.read_fastq(spark, str(tmp_path), "S"))
    before, after = text.split("MapInArrow", 1)
    assert "Exchange hashpartitioning" not in after.split("Union")[0].split("Filter", 1)[0]
    assert text.count("Exchange hashpartitioning") == 1 and "+- Union" in text or "Union" in text


def test_recalibration_needs_no_python(spark):
    v = Views(spark, SF)
    reads = v("contig_reads")
    table = spark.createDataFrame([("rg0", 30, "quality", "", 10, 1, 25.0)], "read_group string, q int, kind string, value string, observations long, mismatches long, empirical double")
    text = plan(recalibrate.apply_recalibration(reads, table))
    assert "Python" not in text and "Arrow" not in text


def test_recalibration_copies_neither_reference_nor_reads(spark, monkeypatch):
    chunks = spark.createDataFrame([("c", k * 40, "ACGT" * 10) for k in range(60) if k != 3] + [("c", 2400, "AC")], "chrom string, start0 long, bases string")
    wide, size = recalibrate._wider(chunks, 40)
    got = {r["start0"]: r["bases"] for r in wide.collect()}
    assert size == 1000 and sorted(got) == [0, 1000, 2000]
    assert got[0] == "ACGT" * 30 + "-" * 40 + "ACGT" * 210 and got[2000] == "ACGT" * 100 + "AC"
    reads = [("rg", 0, "c", pos, f"{n}M", ("ACGT" * 60)[:n], [30] * n) for pos, n in ((1, 100), (101, 100), (981, 200), (2389, 20))]
    reads = spark.createDataFrame(reads, "read_group string, flag int, chrom string, pos long, cigar string, seq string, quals array<int>")
    joined = []
    monkeypatch.setattr(recalibrate, "lookup_join", lambda *a, **k: joined.append(lookup_join(*a, broadcast_rows=0, **k)) or joined[-1])
    table = recalibrate.base_recalibration_table(reads, chunks, None, 40)
    assert "_salt" not in plan(joined[0]) and joined[0].count() == 5  # one read crosses a border of 1000 bases
    assert {r["observations"] for r in table.filter("kind = 'quality'").collect()} == {100 + 80 - 20 + 200 + 14}


def test_coding_changes_are_shuffled_by_place_alone(spark, monkeypatch):
    v = Views(spark, SF)
    features = v("exons").withColumn("feature", F.lit("CDS"))
    table = v("variants").select("chrom", "pos", "ref", "alt")
    reference = spark.createDataFrame([(f"chr{c}", 0, "ACGTTGCA" * 100) for c in range(1, 6)], "chrom string, start0 long, bases string")
    text = plan(variants.coding_changes(table, features, reference, 1000))
    assert not re.search(r"hashpartitioning\(chrom#\d+, pos#\d+L, ref", text)
    monkeypatch.setattr(variants, "lookup_join", None)  # its lookup would be as long as the variants
    assert variants.consequences(table, features, reference, 1000).count() == table.count()


def test_pileups_make_their_reads_once(spark):
    # dealing by ranges reads its input twice
    assert "doc_id" not in plan(QUERIES["pileup"](spark, SF))


def test_placements_do_not_copy_the_reference(spark, monkeypatch):
    letters = spark.createDataFrame([("ACGT", "ACGT"), ("ACNT", "ACNT"), ("ACGT", "AGGA"), ("ACGT", "ACG")], "a string, b string")
    assert [r[0] for r in letters.select(mapping._mismatches(F.col("a"), F.col("b"))).collect()] == [0, 1, 2, 1]
    salts = []
    monkeypatch.setattr(mapping, "lookup_join", lambda *a, **k: salts.append(k.get("salts")) or lookup_join(*a, **k))
    reference = spark.createDataFrame([("c", 0, "ACGTTGCATCGATCGGATCA" * 3)], "chrom string, start0 long, bases string")
    mapping.placements(spark.createDataFrame([("TTGCATCGATCGGATCAACG",)], "seq string"), reference, 8, 1, 1000, 32)
    assert salts == [1, 1]
