"""Pairs, genotypes, readers and sinks on made-up genomes and files with known answers."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seqframe.operators import alignments as al
from seqframe.functions.quality import encode_phred33
from seqframe.functions.skew import lookup_join
from seqframe.operators import de, mapping, pairs, pileup, recalibrate
from seqframe.operators import variants as vr
from seqframe.plans.base_queries import PAIRS_SQL
from seqframe.plans.registry import QUERIES
from seqframe.sources import readers, sinks
from tests.oracle import compare, connect

TURN = str.maketrans("ACGT", "TGCA")


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def chunked(spark, contigs, chunk, overlap):
    rows = [(n, s, b[s : s + chunk + overlap]) for n, b in contigs.items() for s in range(0, len(b), chunk)]
    return spark.createDataFrame(rows, "chrom string, start0 bigint, bases string")


PAIR_READS = "sample_id string, mate int, read_idx bigint, read_id string, seq string"


def test_pairs_find_their_places(spark):
    """Simulated fragments: a repeat told apart by the mate, rescue of a damaged mate, and reads without a partner."""
    rng = random.Random(31)
    repeat = genome(rng, 150)
    contigs = {"c1": genome(rng, 3000) + repeat + genome(rng, 2000) + repeat + genome(rng, 1500), "c2": genome(rng, 4000)}
    rows, truth = [], {}
    for i in range(120):
        name = "c1" if i % 2 else "c2"
        size = rng.randrange(280, 321)
        start = rng.randrange(len(contigs[name]) - size)
        if i % 10 == 1:  # mate 1 in the second copy of the repeat, mate 2 behind it
            start = 5150 + rng.randrange(0, 40)
        frag = contigs[name][start : start + size]
        one, two = frag[:80], frag[-80:][::-1].translate(TURN)
        if i % 16 == 3 and i % 10 != 1:  # an error every 15 bases leaves no seed of 20
            two = "".join(TURN.get(ord(c), 0) and chr(TURN[ord(c)]) if p % 15 == 7 else c for p, c in enumerate(two))
        places = [(name, start + 1, 0), (name, start + size - 80 + 1, 16)]
        if i % 2 == 0:
            one, two, places = two, one, places[::-1]
        rows += [("S", 1, i, f"{i}/1", one), ("S", 2, i, f"{i}/2", two)]
        truth[i, 1], truth[i, 2] = places
    rows += [("S", 1, 1000, "alone", contigs["c2"][100:180]), ("S", 1, None, "nokey", contigs["c2"][200:280]), ("S", 2, None, "nokey2", contigs["c2"][300:380]), ("S", 1, 1001, "x", contigs["c2"][500:580]), ("S", 2, 1001, "y", genome(rng, 80))]
    reads = spark.createDataFrame(rows, PAIR_READS)
    out = pairs.map_pairs(reads, chunked(spark, contigs, 500, 128), k=20, max_mismatch=2, chunk=500, overlap=128).collect()
    assert len(out) == len(rows)
    by = {r["read_id"]: r for r in out}
    for (i, mate), (name, pos, strand) in truth.items():
        r = by[f"{i}/{mate}"]
        assert (r["chrom"], r["pos"], r["flag"] & 16) == (name, pos, strand), (i, mate, r)
        assert r["flag"] & 3 == 3 and r["flag"] & (64 if mate == 1 else 128) and r["rnext"] == "="
        other = by[f"{i}/{3 - mate}"]
        assert r["pnext"] == other["pos"] and r["tlen"] == -other["tlen"] and 280 <= abs(r["tlen"]) <= 320 and bool(r["flag"] & 32) == bool(other["flag"] & 16)
    assert all(by[f"{i}/1"]["mapq"] > 0 for i in range(1, 120, 10))  # the mate tells the copies apart
    assert {by[x]["flag"] for x in ("alone", "nokey", "nokey2")} == {0} and by["nokey2"]["pos"] == 301
    assert (by["x"]["flag"], by["y"]["flag"]) == (1 + 8 + 64, 1 + 4 + 128) and by["y"]["pos"] == by["x"]["pos"] == 501


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], PAIR_READS)
    ref = chunked(spark, {"c": "ACGT" * 100}, 200, 64)
    assert pairs.map_pairs(none, ref, k=20, max_mismatch=2, chunk=200, overlap=64).count() == 0


def piles_of(spark, columns):
    """Piles from (sample, pos, {base: [qualities]})."""
    rows = []
    for sample, pos, bases in columns:
        for base, quals in bases.items():
            e = [min(10 ** (-q / 10), 0.75) for q in quals]
            rows.append((sample, "c", pos, base, len(quals), 0, sum(quals), sum(math.log(1 - x) for x in e), sum(math.log((1 - x) / 2 + x / 6) for x in e), sum(math.log(x / 3) for x in e)))
    return spark.createDataFrame(rows, "sample_id string, chrom string, pos bigint, base string, n_fwd bigint, n_rev bigint, q_sum bigint, ln_self double, ln_half double, ln_error double")


def test_calls_of_two_alternatives(spark):
    ref = spark.createDataFrame([("c", 0, "AAAAAAAAAA")], "chrom string, start0 bigint, bases string")
    sites = [("S", 1, {"C": [30] * 10, "G": [30] * 10}), ("S", 2, {"A": [30] * 10, "G": [30] * 10}), ("S", 3, {"T": [40] * 3000}), ("S", 4, {"A": [30] * 20, "C": [10]}), ("S", 5, {"A": [30] * 9, "C": [30] * 9, "T": [30]})]
    got = {(r["pos"], r["alt"]): r for r in pileup.call_variants(piles_of(spark, sites), ref, 10).collect()}
    assert sorted(got) == [(1, "C"), (1, "G"), (2, "G"), (3, "T"), (5, "C")]
    assert [(r["gt"], r["alts"], r["ad_ref"], r["ad_alt"], r["dp"]) for r in (got[1, "C"], got[1, "G"])] == [("1/2", "C,G", 0, 10, 20)] * 2
    assert got[2, "G"]["gt"] == "0/1" and got[5, "C"]["gt"] == "0/1"
    # log odds of 3,000 bases against the reference, in full
    assert got[3, "T"]["gt"] == "1/1" and got[3, "T"]["qual"] == pytest.approx(3000 * 10 * math.log10((1 - 1e-4) / (1e-4 / 3)), rel=1e-9)
    assert {r["gt"] for r in pileup.call_variants(piles_of(spark, sites[2:3]), ref, 10, ploidy=1).collect()} == {"1"}


def test_genotypes_are_weighed_once(spark):
    """Each likelihood is rounded once and not again in every expression that reads it; QUAL bounds leave out no call."""
    ref = spark.createDataFrame([("c", 0, "AAAAAAAAAA")], "chrom string, start0 bigint, bases string")
    sites = [("S", 1, {"A": [1]}), ("S", 2, {"A": [30] * 5}), ("S", 3, {"A": [30] * 5, "C": [30] * 5}), ("S", 4, {"A": [30] * 30, "C": [12] * 2})]
    calls = pileup.call_variants(piles_of(spark, sites), ref, 10)
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("round(") == 10
    every = pileup.call_variants(piles_of(spark, sites), ref, 10, min_qual=-1000.0).collect()
    assert sorted(map(str, calls.collect())) == sorted(str(r) for r in every if r["qual"] >= 20) != []


def test_calls_are_made_once_for_a_vcf(spark, tmp_path):
    """Header, ranges and rows come from stored calls."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ref = spark.createDataFrame([("c", 0, "AAAAAAAAAA")], "chrom string, start0 bigint, bases string")
    calls = pileup.call_variants(piles_of(spark, [("S", p, {"C": [30] * 10}) for p in range(1, 9)]), ref, 10)
    sinks.write_vcf(calls.mapInArrow(count, calls.schema), spark.createDataFrame([("c", 0)], "chrom string, contig_idx int"), str(tmp_path))
    assert seen.value == 8


def test_vcf_of_many_samples(spark, tmp_path):
    ref = spark.createDataFrame([("c", 0, "AAAAAAAAAA")], "chrom string, start0 bigint, bases string")
    sites = [(s, p, {"C": [30] * 10, "G": [30] * 9}) for s in ("S 1", "T+2") for p in (9, 2)]
    calls = pileup.call_variants(piles_of(spark, sites), ref, 10)
    sinks.write_vcf(calls, spark.createDataFrame([("c", 0)], "chrom string, contig_idx int"), str(tmp_path))
    folders = sorted(p for p in tmp_path.iterdir() if p.is_dir())
    assert len(folders) == 2
    for folder in folders:
        lines = [x for part in sorted(folder.glob("part-*")) for x in part.read_text().splitlines()]
        assert lines[0].startswith("##fileformat=VCF") and [x.split("\t")[:5] for x in lines if x[0] != "#"] == [["c", p, ".", "A", "C,G"] for p in ("2", "9")]
        assert lines[-1].endswith("1/2:19:0,10,9") and lines[-3].split("\t")[-1] in ("S 1", "T+2")


READS = "sample_id string, lane int, mate int, read_idx bigint, read_id string, seq string, quals array<int>"


def test_fastq_by_sample_and_lane(spark, tmp_path):
    rows = [(s, lane, m, i, f"r{i}", "ACGT"[i % 4] * 5, [30 + i % 5] * 5) for s in ("A b", "x+y%z") for lane in (0, 1) for m in (1, 2) for i in range(50)]
    sinks.write_fastq(spark.createDataFrame(rows, READS), str(tmp_path))
    back = readers.read_fastq_tree(spark, str(tmp_path)).select("sample_id", "lane", "mate", "read_id", "seq", "quals").collect()
    assert sorted(map(tuple, back)) == sorted((*r[:3], *r[4:]) for r in rows)


@pytest.mark.parametrize("limit", ["64", "700", "1000000"])
def test_fastq_records_cut_by_splits(spark, tmp_path, limit):
    """Splits shorter than a record, and a truncated last record, in several files."""
    rng = random.Random(5)
    want, n = [], 0
    for f in range(3):
        text = ""
        for i in range(60):
            seq = genome(rng, rng.randrange(1, 90))
            text += f"@q{f}_{i} x\n{seq}\n+\n{'@' * len(seq)}\n"
            want.append((f"f{f}", i, f"q{f}_{i}", seq))
        (tmp_path / f"f{f}.fastq").write_text(text + ("@cut\nAC\n" if f == 1 else ""))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = readers.read_fastq(spark, str(tmp_path)).select("sample_id", "read_idx", "read_id", "seq").collect()
        bad = readers.malformed_fastq(spark, str(tmp_path)).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == sorted(want)
    assert [tuple(r) for r in bad] == [("f1.fastq", 60, "truncated record")]


def test_sam_read_groups(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@RG\tID:g1\tSM:s1\tLB:l1\n@RG\tID:g2\tSM:s2\nq1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:g1\tNH:i:3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\tRG:Z:g2\n")
    (tmp_path / "b.x.sam").write_text("q3\t16\tc\t7\t1\t2M\t*\t0\t0\tAC\t!!\n")
    rows = {r["qname"]: r for r in readers.read_sam(spark, str(tmp_path)).collect()}
    assert [rows["q1"][c] for c in ("sample_id", "library", "read_group", "nh", "quals")] == ["s1", "l1", "g1", 3, [40] * 4]
    assert [rows["q2"][c] for c in ("sample_id", "library", "nh", "quals")] == ["s2", None, 1, None]
    assert [rows["q3"][c] for c in ("sample_id", "read_group", "quals")] == ["b", None, [0, 0]]
    assert len({r["aln_id"] for r in rows.values()}) == 3
    assert {r["sample_id"] for r in readers.read_sam(spark, str(tmp_path), "own").collect()} == {"own"}


def test_linear_index_bounds_both_ends(spark):
    rng = random.Random(6)
    rows = [("c", rng.randrange(1, 200_000), "50M", 0) for _ in range(2000)] + [("c", 1000, "10M150000N10M", 0), ("c", 3000, "*", 4)]
    table = spark.createDataFrame(rows, "chrom string, pos bigint, cigar string, flag int").withColumn("mapq", F.lit(9))
    index = al.linear_index(table)
    for region in ("c:120000-121000", "c:1-10", "c:5000-150000", "c:900000-900100", "d:1-5"):
        want = sorted(map(str, al.view(table.filter("flag = 0"), region).collect()))
        assert sorted(map(str, al.view(table, region, index=index).collect())) == want
    assert al.first_start(index, "c:120000-121000") == 1000 and al.first_start(index, "c:180000-181000") > 160_000


def test_recalibration_by_hand(spark):
    table = [("g", 30, "quality", "", 20.0), ("g", 30, "cycle", "1", 22.0), ("g", 30, "cycle", "-2", 15.0), ("g", 30, "context", "AC", 25.0), ("g", 10, "quality", "", 11.0)]
    table = spark.createDataFrame([(*r[:4], 1, 1, r[4]) for r in table], "read_group string, q int, kind string, value string, observations bigint, mismatches bigint, empirical double")
    rows = [("a", "g", 0, "ACA", [30, 30, 10]), ("b", "g", 128, "NCA", [30, 30, 99]), ("c", "g", 16, "TGT", [10, 30, 30]), ("d", "h", 0, "AC", [30, 30]), ("e", "g", 0, "", []), ("f", None, 0, "AC", [30, 2])]
    reads = spark.createDataFrame(rows, "read_id string, read_group string, flag int, seq string, quals array<int>")
    got = {r["read_id"]: r["quals"] for r in recalibrate.apply_recalibration(reads, table).collect()}
    # empirical 20; cycle 1 adds 2, cycle -2 takes 5, context AC adds 5
    assert got == {"a": [22, 25, 11], "b": [20, 15, 99], "c": [11, 25, 22], "d": [30, 30], "e": [], "f": [30, 2]}


def test_recalibrated_qualities_as_text(spark):
    """A function over Arrow batches takes the qualities as they come out."""
    table = spark.createDataFrame([("g", 30, "quality", "", 1, 1, 20.0)], "read_group string, q int, kind string, value string, observations bigint, mismatches bigint, empirical double")
    reads = spark.createDataFrame([("a", "g", 0, "AC", [30, 2]), ("b", "h", 16, "A", [30]), ("c", "g", 0, None, None)], "read_id string, read_group string, flag int, seq string, quals array<int>")
    out = recalibrate.apply_recalibration(reads, table).select("read_id", encode_phred33(F.col("quals")).alias("qual"), "used_bqsr")
    assert sorted(map(tuple, out.collect())) == [("a", "5#", True), ("b", "?", True), ("c", None, True)]


def test_recalibration_counts_by_batch(spark):
    """Missing qualities, texts and groups, overhanging pieces, second mates and both strands; no row a base."""
    rows = [
        (None, 0, "c", 1, "4M", "ACGT", [30, None]), ("g", 16 + 128, "c", 2, "2M1I2M", "CTAGN", [9, 8, 7, 6, 5]), ("g", 0, "c", 3, "4M", "GT", [3, 3, 3, 3]),
        ("g", 0, "c", 1, "3M", None, [1, 1, 1]), ("g", 0, "c", 1, "3M", "ACG", None), ("g", 0, "c", 6, "4M", "CCGT", [2] * 4), ("g", 0, "c", 1, "2M", "éC", [4, 4]),
    ]
    reads = spark.createDataFrame(rows, "read_group string, flag int, chrom string, pos long, cigar string, seq string, quals array<int>")
    reference = spark.createDataFrame([("c", 0, "ACGTACG")], "chrom string, start0 long, bases string")
    table = recalibrate.base_recalibration_table(reads, reference, None, 1000)
    got = {(str(r["read_group"]), str(r["q"]), r["value"]): (r["observations"], r["mismatches"]) for r in table.filter("kind = 'context'").collect()}
    assert {k: v for k, v in got.items() if k[0] == "None"} == {("None", "None", c): (1, 0) for c in ("AC", "CG", "GT")}
    seen = {(str(r["read_group"]), str(r["q"])): (r["observations"], r["mismatches"]) for r in table.filter("kind = 'quality'").collect()}
    assert seen == {("None", "30"): (1, 0), ("None", "None"): (3, 0), ("g", "9"): (1, 0), ("g", "8"): (1, 1), ("g", "6"): (1, 1), ("g", "3"): (2, 0), ("g", "2"): (2, 1), ("g", "4"): (1, 0)}
    assert "MapInArrow" in table._jdf.queryExecution().toString()


def test_recalibration_of_many_read_groups(spark):
    """No limit on groups: each is a row of its own."""
    groups = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("read_group"), F.explode(F.array(F.lit(30))).alias("q"))
    table = groups.select("read_group", "q", F.lit("quality").alias("kind"), F.lit("").alias("value"), F.lit(1).alias("observations"), F.lit(0).alias("mismatches"), (F.expr("cast(substr(read_group, 2) as int) % 40") + 5.0).alias("empirical"))
    reads = groups.select("read_group", F.lit(0).alias("flag"), F.lit("AC").alias("seq"), F.array(F.lit(30), F.lit(30)).alias("quals"))
    out = recalibrate.apply_recalibration(reads, table)
    assert out.filter(F.expr("quals[1] <> cast(substr(read_group, 2) as int) % 40 + 5")).count() == 0 and out.count() == 3000


def test_designs_of_many_samples(spark):
    """Residual variance and fit don't need the sheet on the driver; more samples than a cap would allow in one cell work alike."""
    rows = [(f"g{g}", f"s{i}", (g + 2) * 5 + (i * 7 + g) % 5 + (20 if i >= 30 and g == 0 else 0)) for g in range(4) for i in range(60)]
    counts = spark.createDataFrame(rows, "gene_id string, sample_id string, cnt bigint")
    sheet = spark.createDataFrame([(f"s{i}", "t" if i >= 30 else "c", f"b{i % 3}") for i in range(60)], "sample_id string, condition string, batch string")
    cells, n, x, tested = de.design_cells(sheet)
    assert n.tolist() == [10.0] * 6 and x.shape == (6, 4) and tested == 3 and cells.count() == 60
    res = {r["gene"]: r for r in de.differential_expression(counts, sheet).collect()}
    assert res["g0"]["log2FoldChange"] > 0.5 and res["g0"]["padj"] < 1e-3 and all(abs(res[g]["log2FoldChange"]) < 0.6 for g in ("g1", "g2", "g3"))


def test_most_severe_change_wins(spark):
    features = spark.createDataFrame([("c", "CDS", "t1", 1, 9, "+"), ("c", "CDS", "t2", 2, 10, "+")], "chrom string, feature string, transcript_id string, start_pos bigint, end_pos bigint, strand string")
    ref = spark.createDataFrame([("c", 0, "ATGTATTGGA")], "chrom string, start0 bigint, bases string")
    variants = spark.createDataFrame([("c", 6, "T", "A"), ("c", 20, "A", "C")], "chrom string, pos bigint, ref string, alt string")
    got = {r["pos"]: (r["change"], r["change_unit"]) for r in vr.consequences(variants, features, ref, 100).collect()}
    assert got == {6: ("stop_gained", "t1"), 20: (None, None)}


def test_pairs_against_their_definition(spark):
    """All pairs of the smallest test tables: flags, places, mates, lengths and qualities as SQL defines them."""
    sf = "/root/testdata/sf0.001"
    assert not compare(spark, connect(sf), sf, "map_pairs", QUERIES["map_pairs"], PAIRS_SQL)[0]


def test_places_of_a_repeat_are_sifted_before_they_are_compared(spark, monkeypatch):
    """Reads that share a word with a thousand places, and little else, are compared at few; palindromes and turned words are found."""
    rng = random.Random(5)
    line, unit = genome(rng, 24), "ACGTACGTACGTACGTACGT"  # the unit is its own reverse complement
    text = "".join(genome(rng, 60) + line for _ in range(1000)) + genome(rng, 50) + unit + genome(rng, 50)
    contigs = [("c", i, text[i : i + 1256]) for i in range(0, len(text), 1000)]
    reference = spark.createDataFrame(contigs, "chrom string, start0 long, bases string")
    at = [84 * 7 + 70, 84 * 500 + 40, len(text) - 90]
    seqs = [text[a : a + 66] for a in at] + [text[84 * 900 + 30 : 84 * 900 + 96][::-1].translate(TURN), genome(rng, 20) + line + genome(rng, 22)]
    rows = []
    monkeypatch.setattr(mapping, "lookup_join", lambda *a, **k: rows.append(a[0]) or lookup_join(*a, **k))
    hits = mapping.placements(spark.createDataFrame([(s,) for s in seqs], "seq string"), reference, 20, 2, 1000, 256)
    assert sorted((r["seq"], r["strand"], r["pos0"], r["mismatches"]) for r in hits.collect()) == sorted([(s, "+", a, 0) for s, a in zip(seqs, at)] + [(seqs[3], "-", 84 * 900 + 30, 0)])
    assert sum(r.count() for r in rows) < 500


def test_collected_reports_are_cut_anywhere(spark, tmp_path):
    """Reports of many samples in one text file, read in splits that cut reports, names and what stands between them."""
    logs = [f"==> logs/U{i}.log <==\n10 reads; of these:\n" + (f"{i}.25% overall alignment rate\n" if i % 4 else "no rate\n") for i in range(90)]
    (tmp_path / "logs.txt").write_text("\n".join(logs))
    reports = [f"==> U{i}_fastqc/summary.txt <==\nPASS\tA\tx\r\nFAIL\tB\tx\n\n==> U{i}_fastqc/fastqc_data.txt <==\nSequence length\t20-{i}\n" for i in range(90)]
    (tmp_path / "qc.txt").write_text("\n".join(reports))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (37, 64, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rates = readers.read_aligner_logs(spark, str(tmp_path / "logs.txt"), collected=True).collect()
            assert {r["sample_id"]: r["mapping_rate"] for r in rates} == {f"U{i}": i + 0.25 if i % 4 else 0.0 for i in range(90)}
            status = readers.read_qc_reports(spark, str(tmp_path / "qc.txt"), collected=True).collect()
            assert sorted(tuple(r) for r in status) == sorted((f"U{i}", m, s) for i in range(90) for m, s in (("A", "PASS"), ("B", "FAIL")))
            lengths = readers.read_qc_lengths(spark, str(tmp_path / "qc.txt"), collected=True).collect()
            assert {r["sample_id"]: r["read_length"] for r in lengths} == {f"U{i}": i for i in range(90)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reports_of_many_samples_are_few_files(spark, tmp_path, monkeypatch):
    """Files that grow with the samples take the scan longer to list than to read."""
    for name in ("read_aligner_logs", "read_qc_reports"):
        monkeypatch.setattr("seqframe.plans.source_queries.shared_dir", lambda s, n=name: str(tmp_path / n))
        samples = QUERIES[name](spark, "/root/testdata/sf0.01").select("sample_id").distinct().count()
        assert len(list((tmp_path / name).rglob("part-*"))) < 50 < samples


def test_part_files_of_a_folder_are_one_file(spark, tmp_path):
    """Records numbered over parts, some of which cut a record, and a SAM header in another part than the rows."""
    lines = [x for i in range(50) for x in (f"@r{i}", "ACGT"[: i % 4 + 1], "+", "IIII"[: i % 4 + 1])]
    (tmp_path / "R1").mkdir()
    for k, at in enumerate(range(0, 200, 22)):
        (tmp_path / "R1" / f"part-{k:05}.txt").write_text("".join(x + "\n" for x in lines[at : at + 22]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (29, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.read_fastq(spark, str(tmp_path / "R1"), "S", parts=True).select("read_idx", "read_id", "seq").collect()
            assert sorted(map(tuple, got)) == [(i, f"r{i}", "ACGT"[: i % 4 + 1]) for i in range(50)]
            pairs_ = readers.read_fastq_pairs(spark, str(tmp_path / "R1"), str(tmp_path / "R1"), "S", parts=True)
            assert pairs_.count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "x.sam").mkdir()
    (tmp_path / "x.sam" / "part-00000.txt").write_text("@SQ\tSN:c2\tLN:7\n@SQ\tSN:c1\tLN:9\n@RG\tID:g\tSM:T\tLB:l\n")
    (tmp_path / "x.sam" / "part-00001.txt").write_text("@SQ\tSN:c0\tLN:5\nq1\t0\tc1\t5\t9\t4M\t*\t0\t0\t*\t*\tRG:Z:g\nq2\t0\tc1\t5\t9\t4M\t*\t0\t0\t*\t*\n")
    rows = readers.read_sam(spark, str(tmp_path / "x.sam")).select("qname", "sample_id", "library").collect()
    assert sorted(map(tuple, rows)) == [("q1", "T", "l"), ("q2", "x", None)]
    contigs = readers.read_sam_contigs(spark, str(tmp_path / "x.sam")).collect()
    assert sorted((r["contig_idx"], r["chrom"], r["length"]) for r in contigs) == [(0, "c2", 7), (1, "c1", 9), (2, "c0", 5)]


def test_no_task_writes_or_numbers_a_whole_file(spark, tmp_path, monkeypatch):
    for name in ("read_fastq", "read_sam_duplicates", "read_sam_contigs"):
        monkeypatch.setattr("seqframe.plans.source_queries.shared_dir", lambda s, n=name: str(tmp_path / n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = QUERIES[name](spark, "/root/testdata/sf0.001")
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = {p.name.split("-")[1] for p in (tmp_path / name).rglob("part-*.txt")}
        assert len(parts) > 4 and out.count()
