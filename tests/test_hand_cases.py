"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from seqframe.functions.ordering import bh_adjust
from seqframe.operators import alignments as al
from seqframe.operators import counts as ct
from seqframe.operators import coverage as cv
from seqframe.operators import de, decide, enrich, qc, runs, trim
from seqframe.operators import samples as sm
from seqframe.operators import variants as vr
from seqframe.plans import flows
from seqframe.sources import readers


def flags(spark, fails, warns):
    rows = [("S", f"f{i}", "FAIL") for i in range(fails)] + [("S", f"w{i}", "WARN") for i in range(warns)] + [("S", "ok", "PASS")]
    return spark.createDataFrame(rows, "sample_id string, module string, status string")


@pytest.mark.parametrize(
    "fails,warns,verdict,confidence",
    [(0, 0, "pass", 0.55), (1, 0, "trim_required", 0.65), (0, 3, "trim_required", 0.64), (2, 0, "fail", 0.75), (9, 9, "fail", 0.95)],
)
def test_qc_verdict(spark, fails, warns, verdict, confidence):
    row = decide.qc_verdict(flags(spark, fails, warns)).first()
    assert (row["verdict"], row["confidence"]) == (verdict, confidence)
    assert row["quality_summary"] == f"{fails} failures, {warns} warnings in FastQC modules."


def test_trim_decision_policies(spark):
    none = spark.createDataFrame([("S",), ("T",)], "sample_id string")
    rows = {r["sample_id"]: r for r in decide.trim_decision(flags(spark, 0, 4), none).collect()}
    assert (rows["T"]["trim"], rows["T"]["confidence"]) == (False, 0.45)
    assert (rows["S"]["trim"], rows["S"]["sliding"], rows["S"]["min_len"]) == (True, "4:21", 38)
    tool = decide.trim_decision(flags(spark, 1, 3), policy="tool").first()
    assert (tool["sliding"], round(tool["confidence"], 9)) == ("4:21", 0.72)
    strong = decide.trim_decision(flags(spark, 2, 0)).first()
    assert (strong["leading_q"], strong["sliding"], strong["min_len"]) == (5, "4:22", 40)


def test_normalize_trim_params(spark):
    rows = spark.createDataFrame(
        [(1, "99", "3", "x", "10"), (2, "abc", "9", "5:9", "50"), (3, None, None, None, None)],
        "id int, leading_q string, trailing_q string, sliding string, min_len string",
    )
    got = {r["id"]: tuple(r)[1:] for r in decide.normalize_trim_params(rows).collect()}
    assert got == {1: (40, 3, "4:20", 36), 2: (3, 3, "4:20", 36), 3: (3, 3, "4:20", 36)}


def test_external_verdicts(spark):
    heuristic = decide.qc_verdict(flags(spark, 0, 0))
    cases = {
        'x {"verdict":"needs trimming","reasoning":"r","quality_summary":"s","confidence":7} y': ("trim_required", 1.0, "external"),
        '{"verdict":"ACCEPTED","reasoning":"r","quality_summary":"s","confidence":"0.12345"}': ("pass", 0.123, "external"),
        '{"verdict":"perhaps","reasoning":"r","quality_summary":"s","confidence":1}': ("pass", 0.55, "heuristic"),
        '{"verdict":"fail","reasoning":"r","confidence":1}': ("pass", 0.55, "heuristic"),
        "no json at all": ("pass", 0.55, "heuristic"),
    }
    for raw, expected in cases.items():
        verdicts = spark.createDataFrame([("S", raw)], "sample_id string, raw string")
        row = decide.merge_external_verdicts(heuristic, verdicts).first()
        assert (row["verdict"], row["confidence"], row["source"]) == expected


def test_gates(spark):
    rates = spark.createDataFrame([("a", 60.0), ("b", 59.99)], "sample_id string, mapping_rate double")
    assert [(r["status"], r["action"]) for r in decide.alignment_gate(rates).orderBy("sample_id").collect()] == [("pass", None), ("fail", "abort")]
    depths = spark.createDataFrame([("a", "30"), ("b", "29.999"), ("c", "n/a")], "sample_id string, mean_depth string")
    got = [tuple(r)[1:] for r in decide.coverage_gate(depths, threshold="0").orderBy("sample_id").collect()]
    assert got == [
        (30.0, 30.0, True, "ok", False, ""),
        (29.999, 30.0, False, "warn", True, "Coverage below threshold"),
        (None, 30.0, False, "warn", True, "Coverage not available"),
    ]


READS = "sample_id string, mate int, read_idx bigint, read_id string, seq string, quals array<int>"


def test_fastq_sample(spark, tmp_path):
    (tmp_path / "sample.fastq").write_text("@read1\nACGTACGT\n+\nIIIIIIII\n@read2\nTGCATGCA\n+\nIIIIIIII\n")
    reads = readers.read_fastq(spark, str(tmp_path / "sample.fastq"))
    profile = qc.read_profile(reads)
    stats = qc.basic_stats(profile).first()
    assert (stats["sample_id"], stats["n_reads"], stats["length_label"], stats["read_length"], stats["pct_gc"]) == ("sample", 2, "8", 8, 50.0)
    assert qc.per_sequence_quality(profile).first()["mean_q"] == 40
    assert qc.read_count(reads).first()["n_reads"] == 2


def test_trim_steps(spark):
    reads = spark.createDataFrame([("S", 0, 0, "r", "ACGTACGTAC", [2, 2, 30, 30, 30, 30, 10, 10, 10, 2])], READS)
    assert trim.trim_leading(reads, 3).first()["seq"] == "GTACGTAC"
    assert trim.trim_trailing(reads, 3).first()["seq"] == "ACGTACGTA"
    # windows of 4 from base 3: means 30, 25, 20, 15 -> the fourth is the first below 20
    lead = trim.trim_leading(reads, 3)
    assert trim.trim_sliding_window(lead, 4, 20).first()["seq"] == "GTA"
    short = spark.createDataFrame([("S", 0, 0, "r", "ACG", [2, 2, 2])], READS)
    assert trim.trim_sliding_window(short, 4, 20).first()["seq"] == "ACG"
    assert trim.trim_leading(short, 3).first()["seq"] == ""
    assert trim.trim_reads(reads).count() == 0


def test_bed_vcf_and_info(spark, tmp_path):
    (tmp_path / "p.bed").write_text("# c\n\nchr1\t0\t100\nchr2\t5\t9\tG1\nchr3\t1\n")
    bed = {r["chrom"]: (r["name"], r["region"]) for r in readers.read_bed(spark, str(tmp_path / "p.bed")).collect()}
    assert bed == {"chr1": ("chr1:0-100", "chr1:1-100"), "chr2": ("G1", "chr2:6-9")}
    info = ["ANN=T|missense_variant|MODERATE|TP53", "ANN=T|x", "GENE=A;GENE=;CLNSIG=Benign", "DB;GENE=A;GENE=B", "."]
    (tmp_path / "v.vcf").write_text("##x\n" + "".join(f"chr1\t{i}\t.\tA\tC\t9\tPASS\t{t}\n" for i, t in enumerate(info, 1)))
    table = vr.variants_table(readers.read_vcf(spark, str(tmp_path / "v.vcf"))).orderBy("pos").collect()
    assert [(r["gene"], r["effect"], r["pathogenicity"]) for r in table] == [
        ("TP53", "missense_variant", "UNKNOWN"), ("NA", "x", "UNKNOWN"), ("NA", "NA", "Benign"), ("B", "NA", "UNKNOWN"), ("NA", "NA", "UNKNOWN"),
    ]


def test_variant_placeholder(spark):
    none = spark.createDataFrame([], "chrom string, pos bigint, ref string, alt string, qual string, filter string, info string")
    row = vr.variants_or_placeholder(vr.variants_table(none)).collect()
    assert [tuple(r) for r in row] == [("chr1", 0, "N", "N", "NA", "NA", "NA", ".", ".", ".")]


def test_bh(spark):
    p = [0.005, 0.01, 0.03, 0.04, 0.04, 0.5, None]
    rows = spark.createDataFrame(list(enumerate(p)), "i int, pvalue double")
    got = [r["padj"] for r in bh_adjust(rows).orderBy("i").collect()]
    assert got[:-1] == pytest.approx([0.03, 0.03, 0.048, 0.048, 0.048, 0.5]) and got[-1] is None


ALN = "sample_id string, aln_id bigint, qname string, flag int, chrom string, pos bigint, mapq int, cigar string, nh int"


def test_blocks_counts_and_depth(spark):
    rows = [
        ("S", 1, "a", 0, "c", 11, 60, "5M10N5M", 1),  # 11-15, 26-30
        ("S", 2, "b", 16, "c", 13, 60, "2S4M2D4M", 1),  # 13-22 with 17-18 deleted
        ("S", 3, "d", 4, "*", 0, 0, "*", None),
        ("S", 4, "e", 0, "c", 11, 3, "5M", 2),
        ("S", 5, "f", 0, "c", 500, 3, "5M", 1),
    ]
    aln = spark.createDataFrame(rows, ALN)
    blocks = {(r["aln_id"], r["start_pos"], r["end_pos"]) for r in al.alignment_blocks(aln).collect()}
    assert blocks == {(1, 11, 15), (1, 26, 30), (2, 13, 22), (4, 11, 15), (5, 500, 504)}
    exons = spark.createDataFrame([("c", "G1", 1, 15), ("c", "G2", 16, 25)], "chrom string, gene_id string, start_pos bigint, end_pos bigint")
    got = {r["aln_id"]: (r["status"], r["gene_id"]) for r in ct.assign_reads(aln, exons).collect()}
    assert got == {
        1: ("Assigned", "G1"),
        2: ("Unassigned_Ambiguity", None),
        3: ("Unassigned_Unmapped", None),
        4: ("Unassigned_MultiMapping", None),
        5: ("Unassigned_NoFeatures", None),
    }
    counts = {r["gene_id"]: r["cnt"] for r in ct.feature_counts(ct.assign_reads(aln, exons), exons).collect()}
    assert counts == {"G1": 1, "G2": 0}
    runs_ = [(r["start_pos"], r["end_pos"], r["depth"]) for r in cv.depth(aln).orderBy("start_pos").collect()]
    assert runs_ == [(11, 12, 2), (13, 15, 3), (16, 16, 1), (19, 22, 1), (26, 30, 1), (500, 504, 1)]
    beds = spark.createDataFrame([("c", 10, 20, "x"), ("c", 10, 20, "x"), ("z", 0, 5, None)], "chrom string, start0 bigint, end0 bigint, name string")
    cov = [(r["gene"], r["region"], r["mean_depth"]) for r in cv.region_mean_depth(cv.depth(aln), beds).orderBy("gene").collect()]
    # covered positions of c:11-20 are 11-16 and 19-20: (2*2 + 3*3 + 1 + 2) / 8
    assert cov == [("x", "c:11-20", 2.0), ("x", "c:11-20", 2.0), ("z:0-5", "z:1-5", 0.0)]


def test_duplicate_marking(spark):
    rows = [
        ("S", "L", "a", 0, "c", 10, "10M", 100),
        ("S", "L", "b", 0, "c", 12, "2S8M", 90),  # same unclipped 5' end
        ("S", "L", "d", 16, "c", 1, "10M", 50),  # reverse, ends at 10
        ("S", "L", "e", 0, "c", 11, "10M", 10),
        ("S", "L", "f", 256, "c", 10, "10M", 999),
    ]
    aln = spark.createDataFrame(rows, "sample_id string, library string, qname string, flag int, chrom string, pos bigint, cigar string, score bigint")
    marked = al.mark_duplicates(aln, F.col("score"))
    assert {r["qname"] for r in marked.collect() if r["flag"] & 0x400} == {"b"}
    metrics = al.duplication_metrics(marked).first()
    assert (metrics["examined"], metrics["duplicates"], metrics["pct_duplicates"]) == (4, 1, 25.0)
    # 4 reads, 3 distinct: x with 3 = x (1 - exp(-4 / x))
    x = metrics["library_size"]
    import math

    assert x * (1 - math.exp(-4 / x)) <= 3 <= (x + 1) * (1 - math.exp(-4 / (x + 1)))


def test_design_errors(spark):
    counts = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "gene_id string, sample_id string, cnt bigint")
    sheet = lambda *c: spark.createDataFrame(list(zip("ab", c)), "sample_id string, condition string")
    with pytest.raises(ValueError, match="one condition"):
        de.align_design(counts, sheet("x", "x"))
    with pytest.raises(ValueError, match="counted and listed"):
        de.align_design(counts.filter("sample_id = 'a'"), sheet("x", "y"))
    with pytest.raises(ValueError, match="needs a sheet"):
        de.align_design(counts, sheet("x", "y").drop("condition"))
    assert {r["batch"] for r in de.align_design(counts, sheet("x", "y"))[1].collect()} == {"batch1"}
    row = de.contrast_levels(sheet("treated", "control")).first()
    assert (row["test_level"], row["base_level"]) == ("treated", "control")


def test_sheet_rules(spark):
    sheet = spark.createDataFrame(
        [(1, "a", "x.fq"), (2, "a", ""), (3, None, "y.fq")], "row_no bigint, sample_id string, fastq string"
    )
    paths = spark.createDataFrame([("x.fq",)], "path string")
    got = sorted((r["row_no"], r["rule"]) for r in sm.validate_samples(sheet, False, "WGS", "fly", paths=paths).collect())
    assert got == [(0, "duplicate"), (0, "organism"), (0, "reference_fasta"), (2, "fastq"), (3, "path"), (3, "sample_id")]
    assert sm.single_sample(spark, "x.fq").first()["sample_id"] == "sample-01"


def test_halts_and_verification(spark):
    rows = [("r", "a", "qc", True, "", ""), ("r", "a", "ingest", True, "stop", ""), ("r", "a", "align", False, "", ""), ("r", "b", "qc", True, "", "why")]
    results = spark.createDataFrame(rows, "run_id string, sample_id string, stage string, halt boolean, halt_reason string, reasoning string")
    got = {r["sample_id"]: (r["stage"], r["reason"]) for r in runs.first_halts(results).collect()}
    assert got == {"a": ("ingest", "stop"), "b": ("qc", "why")}
    assert {(r["sample_id"], r["stage"]) for r in runs.halt_gate(results).collect()} == {("a", "ingest"), ("b", "qc")}
    expected = spark.createDataFrame([("r", "s1", "x"), ("r", "s2", "y")], "run_id string, step string, artifact string")
    outcomes = spark.createDataFrame([("r", "s1", 1, "x")], "run_id string, step string, returncode int, artifact string")
    issues = {(r["severity"], r["message"]) for r in runs.verify_artifacts(expected, outcomes).collect()}
    assert issues == {("error", "step s1 ended with exit code 1"), ("warning", "no step produced y")}
    assert tuple(runs.verification_metrics(expected, outcomes).first()) == ("r", False, 2, 1, 2, 1)


def test_term_cycle_is_finite_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], "child string, parent string")
    got = {(r["term"], r["ancestor"]) for r in enrich.term_closure(edges).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abcd" if x <= y}


def test_lanes_of_pairs(spark, tmp_path):
    for mate in (1, 2):
        for lane, n in ((1, 3), (2, 2 + mate % 2)):
            text = "".join(f"@l{lane}r{i}/{mate}\nACGT\n+\nIIII\n" for i in range(n))
            (tmp_path / f"R{mate}").mkdir(exist_ok=True)
            (tmp_path / f"R{mate}" / f"s_L00{lane}_R{mate}.fastq").write_text(text)
    one, two = (readers.read_lanes(spark, str(tmp_path / f"R{m}"), "S", m) for m in (1, 2))
    pairs = readers.read_fastq_pairs(spark, str(tmp_path / "R1"), str(tmp_path / "R2"), "S")
    assert pairs.count() == 10 and {(r.lane, r.read_idx) for r in pairs.collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}
    assert tuple(readers.pair_report(one, two).first()) == ("S", 6, 5, 5, False)
    assert {r.fate for r in trim.split_pairs(one).collect()} == {"unpaired"}


def test_reads_without_params_get_the_defaults(spark):
    reads = spark.createDataFrame([("A", 1, 0, "r", "ACGT" * 12, [40] * 48), ("B", 1, 0, "r", "ACGT" * 12, [40] * 48)], "sample_id string, mate int, read_idx long, read_id string, seq string, quals array<int>")
    params = trim.trim_reads(reads, spark.createDataFrame([("A", 3, 3, "4:20", 36)], "sample_id string, leading_q int, trailing_q int, sliding string, min_len int"))
    assert {r.sample_id for r in params.collect()} == {"A", "B"}


def test_null_keys(spark):
    rows = [("S", None, f"q{i}", 0, "c", 100 * i + 1, "10M", "A" * 10, [30] * 10) for i in range(3)]
    table = spark.createDataFrame(rows, "sample_id string, library string, qname string, flag int, chrom string, pos long, cigar string, seq string, quals array<int>")
    table = table.withColumns({"rnext": F.lit("*"), "pnext": F.lit(0)})
    assert {r.flag for r in al.mark_duplicates(table).collect()} == {0}
    runs_ = spark.createDataFrame([("S", "c", 1, 10, 2)], "sample_id string, chrom string, start_pos long, end_pos long, depth long")
    regions = spark.createDataFrame([("c", 0, 10, None)], "chrom string, start0 long, end0 long, name string")
    assert cv.region_mean_depth(runs_, regions).first().mean_depth == 2.0


def test_empty_rerun_replaces_its_own_rows(spark, tmp_path):
    run = flows.Run(str(tmp_path), "r1")
    table = spark.createDataFrame([(1, "x")], "a int, b string")
    assert run.store("s", table.limit(0)).count() == 0
    assert run.store("s", table).count() == 1
    assert flows.Run(str(tmp_path), "r2").store("s", table).count() == 1
    assert run.store("s", table.limit(0)).count() == 0
    assert spark.read.parquet(f"{tmp_path}/stage=s").count() == 1


def test_gtf_values_with_semicolons(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('c\ts\tCDS\t1\t9\t.\t+\t0\tgene_id "a"; note "x; gene_id b"; transcript_id "t1"; level 2;\n')
    row = readers.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (row.gene_id, row.transcript_id, row.attrs["level"], row.attrs["note"]) == ("a", "t1", "2", "x; gene_id b")


def test_size_factors_need_a_gene_counted_everywhere(spark):
    counts = spark.createDataFrame([("g", "a", 1), ("g", "b", 0), ("h", "a", 0), ("h", "b", 2)], "gene_id string, sample_id string, cnt long")
    with pytest.raises(Exception, match="size factors are undefined"):
        de.size_factors(counts).collect()
