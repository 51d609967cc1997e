"""Operators against brute force on small random data, and behaviour on splits and hot keys."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.functions.ordering import bh_adjust, exact_median, float_bucket
from seqframe.functions.skew import lookup_join
from seqframe.functions.special import hypergeom_upper_tail, log_factorial
from seqframe.operators import coverage as cv
from seqframe.operators import de, mapping, pileup, trim
from seqframe.operators.intervals import overlap_join
from seqframe.plans import flows
from seqframe.sources import readers, sinks


def test_running_order_statistics(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([0.0, 0.25, rng.gauss(0, 3), -rng.random() * 1e-9])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["m"] for r in exact_median(df, ["k"], "x", "m").collect()}
    for k in "ab":
        assert got[k] == pytest.approx(np.median([x for kk, x in rows if kk == k]), abs=1e-15)
    ordered = [r["b"] for r in df.orderBy("x").select(float_bucket(F.col("x")).alias("b")).collect()]
    assert ordered == sorted(ordered)


def test_bh_against_numpy(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(3000), rng.random(50) * 1e-12, np.ones(1500)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, pvalue double")
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    expected = np.empty_like(p)
    expected[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    got = np.array([r["padj"] for r in bh_adjust(df).orderBy("i").collect()])
    assert np.allclose(got, expected, rtol=1e-12)


def test_bh_of_values_that_differ_when_computed_again(spark):
    """As means of doubles do, whose summands reach a task in another order each time."""
    noise = F.udf(lambda: int.from_bytes(os.urandom(4)) / 2**32, "double").asNondeterministic()
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), (F.col("id") / 1000 + noise() * 1e-9 + 1e-9).alias("p"))
    got = [r["padj"] for r in bh_adjust(df, "p", by=["g"]).collect()]
    assert len(got) == 500 and None not in got


def test_lookup_join_salted_equals_broadcast(spark):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, lookup_join(fact, lookup, ["k"], how).collect()))
        b = sorted(map(str, lookup_join(fact, lookup, ["k"], how, broadcast_rows=1).collect()))
        assert a == b


def test_overlap_join_brute_force(spark):
    rng = random.Random(3)
    spans = lambda n, w: [(rng.choice("xy"), i, s, s + rng.randrange(w)) for i in range(n) for s in [rng.randrange(5000)]]
    a, b = spans(200, 400), spans(60, 900)
    left = spark.createDataFrame(a, "chrom string, a int, start_pos bigint, end_pos bigint")
    right = spark.createDataFrame(b, "chrom string, b int, start_pos bigint, end_pos bigint")
    expected = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    for size in (64, 16384):
        assert sorted((r["a"], r["b"]) for r in overlap_join(left, right, bin_size=size).collect()) == expected
    kept = overlap_join(left, right, keep_unmatched=True, bin_size=64)
    assert sorted((r["a"], r["b"]) for r in kept.filter("b is not null").collect()) == expected
    assert kept.select("a").distinct().count() == 200


def test_depth_brute_force_across_bins(spark, monkeypatch):
    monkeypatch.setattr(cv, "SWEEP_BIN", 64)
    rng = random.Random(4)
    rows = [("S", i, 0, "c", rng.choice([100, rng.randrange(1, 2000)]), f"{rng.randrange(5, 300)}M") for i in range(300)]
    aln = spark.createDataFrame(rows, "sample_id string, aln_id bigint, flag int, chrom string, pos bigint, cigar string")
    expected = {}
    for r in rows:
        for p in range(r[4], r[4] + int(r[5][:-1])):
            expected[p] = expected.get(p, 0) + 1
    runs = cv.depth(aln).orderBy("start_pos").collect()
    got = {p: r["depth"] for r in runs for p in range(r["start_pos"], r["end_pos"] + 1)}
    assert got == expected
    assert all(a["depth"] != b["depth"] or a["end_pos"] + 1 < b["start_pos"] for a, b in zip(runs, runs[1:]))


def test_pileup_of_a_hot_locus(spark):
    """A locus of equal reads is spread over tasks and merged without changing a number; gapped reads are placed right."""
    rng = random.Random(13)
    rows, expected = [], {}
    for i in range(400):
        pos, flag = rng.choice([40, rng.randrange(1, 400)]), rng.choice([0, 16])
        seq = "".join(rng.choice("ACGT") for _ in range(20))
        cigar = rng.choice(["20M", "3S10M2D7M", "8M2I10M", "5M30N15M"])
        rows.append(("S", "c", flag, pos, cigar, seq, [rng.randrange(2, 41) for _ in range(20)]))
        at, read = pos, 0
        for n, op in re.findall(r"(\d+)([MIDNS])", cigar):
            for _ in range(int(n)):
                if op in "MD":
                    key = (at, seq[read] if op == "M" else "*")
                    e = expected.setdefault(key, [0, 0, 0])
                    e[flag == 16] += 1
                    e[2] += rows[-1][6][read] if op == "M" else 0
                at += op in "MDN"
                read += op in "MIS"
    aln = spark.createDataFrame(rows, "sample_id string, chrom string, flag int, pos bigint, cigar string, seq string, quals array<int>")
    tables = [pileup.pileup(x).collect() for x in (aln.coalesce(1), aln.repartition(7))]
    for table in tables:
        assert {(r["pos"], r["base"]): [r["n_fwd"], r["n_rev"], r["q_sum"]] for r in table} == expected
    sums = [{(r["pos"], r["base"]): round(r["ln_half"], 6) for r in t} for t in tables]
    assert sums[0] == sums[1]
    same = aln.filter("pos = 40").limit(1).crossJoin(spark.range(4000)).drop("id")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        dealt = same.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("sample_id", "chrom", "pos", "_row")
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) == 8 and max(sizes) < 1000
    assert {r["n_fwd"] + r["n_rev"] for r in pileup.pileup(same).collect() if r["base"] != "*"} == {4000}


READS = "sample_id string, mate int, read_idx bigint, read_id string, seq string, quals array<int>"


def random_reads(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.randrange(1, 120)
        seq = "".join(rng.choice("ACGT") for _ in range(size))
        rows.append(("S", 1, i, f"r{i:06d}", seq, [rng.choice([2, 31, 31, 35, 40, 40, 40]) for _ in range(size)]))
    return rows


def test_trimmed_reads_are_substrings(spark):
    rows = random_reads(300, 5)
    by_id = {r[3]: r for r in rows}
    out = trim.trim_reads(spark.createDataFrame(rows, READS)).collect()
    assert out
    for r in out:
        raw = by_id[r["read_id"]]
        assert r["seq"] in raw[4] and len(r["seq"]) == len(r["quals"]) >= 36 and r["quals"][0] >= 3


def test_fastq_across_small_splits(spark, tmp_path):
    """Quality lines that start with @ and file splits inside records."""
    rows = random_reads(2000, 6)
    for part in range(3):
        text = "".join(f"@{r[3]}\n{r[4]}\n+\n{''.join(chr(q + 33) for q in r[5])}\n" for r in rows[part::3])
        (tmp_path / f"lane{part}.fastq").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = readers.read_fastq(spark, str(tmp_path)).select("sample_id", "read_idx", "read_id", "seq", "quals").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = sorted((f"lane{p}", i, r[3], r[4], r[5]) for p in range(3) for i, r in enumerate(rows[p::3]))
    assert sorted(map(tuple, got)) == expected


def test_fasta_across_small_splits(spark, tmp_path):
    rng = random.Random(7)
    contigs = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 9000))) for i in range(12)}
    lines = []
    for name, seq in contigs.items():
        lines.append(f">{name} description")
        lines += [seq[i : i + 70] for i in range(0, len(seq), 70)]
    (tmp_path / "ref.fa").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = {(r["chrom"], r["start0"]): r["bases"] for r in readers.read_fasta(spark, str(tmp_path), 500, 40).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {(n, k): s[k : k + 540] for n, s in contigs.items() for k in range(0, len(s), 500)}
    assert got == expected


def test_fastq_round_trip(spark, tmp_path):
    rows = random_reads(500, 8)
    sinks.write_fastq(spark.createDataFrame(rows, READS), str(tmp_path / "S"))
    back = readers.read_fastq(spark, str(tmp_path / "S"), "S", 1).collect()
    assert sorted((r["read_id"], r["seq"], r["quals"]) for r in back) == sorted((r[3], r[4], r[5]) for r in rows)


def test_truncated_record_is_reported(spark, tmp_path):
    (tmp_path / "t.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\n+\n")
    assert readers.read_fastq(spark, str(tmp_path / "t.fastq")).count() == 1
    assert tuple(readers.malformed_fastq(spark, str(tmp_path / "t.fastq")).first()) == ("t.fastq", 1, "truncated record")


def test_map_reads_brute_force(spark):
    rng = random.Random(9)
    core = "".join(rng.choice("ACGT") for _ in range(900))
    contigs = {"c1": core + "A" * 120, "c2": core[100:400] + "".join(rng.choice("ACGT") for _ in range(500))}
    turn = str.maketrans("ACGT", "TGCA")
    reads = []
    for i in range(120):
        name = rng.choice(list(contigs))
        start = rng.randrange(len(contigs[name]) - 48)
        seq = list(contigs[name][start : start + 48])
        for _ in range(rng.randrange(5)):
            p = rng.randrange(48)
            seq[p] = rng.choice("ACGT")
        text = "".join(seq)
        reads.append((f"r{i}", text if i % 2 else text[::-1].translate(turn)))
    k, m, chunk, overlap = 12, 2, 100, 64

    def brute(seq):
        hits = []
        for strand, q in (("+", seq), ("-", seq[::-1].translate(turn))):
            for name, ref in contigs.items():
                for p in range(len(ref) - len(q) + 1):
                    d = sum(a != b for a, b in zip(q, ref[p : p + len(q)]))
                    if d <= m:
                        hits.append((d, name, p, strand))
        if not hits:
            return (4, "*", 0, 0, None, 0)
        best = min(h[0] for h in hits)
        first = min(h[1:] for h in hits if h[0] == best)
        n = sum(h[0] == best for h in hits)
        second = min((h[0] for h in hits if h[0] > best), default=m + 1)
        return (16 if first[2] == "-" else 0, first[0], first[1] + 1, 0 if n > 1 else min(60, 20 * (second - best)), best, n)

    reference = spark.createDataFrame(
        [(n, s, r[s : s + chunk + overlap]) for n, r in contigs.items() for s in range(0, len(r), chunk)],
        "chrom string, start0 bigint, bases string",
    )
    table = spark.createDataFrame([("S", i, s) for i, s in reads], "sample_id string, read_id string, seq string")
    out = mapping.map_reads(table, reference, k, m, chunk, overlap)
    got = {r["read_id"]: (r["flag"], r["chrom"], r["pos"], r["mapq"], r["nm"], r["nh"]) for r in out.collect()}
    assert got == {i: brute(s) for i, s in reads}


def test_hypergeometric_tail(spark):
    cases = [(3, 10, 12, 60), (1, 5, 5, 40), (7, 7, 9, 30), (2, 300, 450, 20000), (10, 12, 10, 15)]
    df = spark.createDataFrame(cases, "k bigint, n bigint, m bigint, big bigint")
    got = [r["p"] for r in df.select(hypergeom_upper_tail(F.col("k"), F.col("n"), F.col("m"), F.col("big")).alias("p")).collect()]
    for (k, n, m, big), p in zip(cases, got):
        exact = sum(math.comb(m, i) * math.comb(big - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(big, n)
        assert p == pytest.approx(exact, rel=1e-9)
    facts = [r[0] for r in spark.range(30).orderBy("id").select(log_factorial(F.col("id"))).collect()]
    assert facts == pytest.approx([math.lgamma(i + 1) for i in range(30)], abs=1e-11)


def simulated_counts(seed=10, genes=400, per_group=5):
    rng = np.random.default_rng(seed)
    depth = rng.uniform(0.6, 1.6, 2 * per_group)
    mean = rng.lognormal(5, 1, genes)
    lfc = np.where(np.arange(genes) < 40, rng.choice([-2.0, 2.0], genes), 0.0)
    rows, shape = [], 1 / 0.05
    for g in range(genes):
        for s in range(2 * per_group):
            mu = mean[g] * depth[s] * 2 ** (lfc[g] if s >= per_group else 0)
            rows.append((f"g{g:04d}", f"s{s:02d}", int(rng.negative_binomial(shape, shape / (shape + mu)))))
    sheet = [(f"s{s:02d}", "treated" if s >= per_group else "control", f"b{s % 2}") for s in range(2 * per_group)]
    return rows, sheet, lfc


def test_fold_changes_are_recovered(spark):
    rows, sheet, lfc = simulated_counts()
    counts = spark.createDataFrame(rows, "gene_id string, sample_id string, cnt bigint")
    samples = spark.createDataFrame(sheet, "sample_id string, condition string, batch string")
    res = {r["gene"]: r for r in de.differential_expression(counts, samples).collect()}
    estimate = np.array([res[f"g{g:04d}"]["log2FoldChange"] for g in range(len(lfc))])
    hits = np.array([(res[f"g{g:04d}"]["padj"] or 1) < 0.05 for g in range(len(lfc))])
    assert np.abs(estimate - lfc).mean() < 0.25
    assert hits[:40].mean() > 0.95 and hits[40:].mean() < 0.05


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 6)) + np.outer(rng.normal(size=60) * 3, [1, 1, 1, -1, -1, -1])
    rows = [(f"g{g:03d}", f"s{s}", float(x[g, s])) for g in range(60) for s in range(6)]
    vst = spark.createDataFrame(rows, "gene_id string, sample_id string, vst double")
    top = np.argsort(-x.var(axis=1, ddof=1))[:20]
    centred = x[top] - x[top].mean(axis=1, keepdims=True)
    u, d, vt = np.linalg.svd(centred, full_matrices=False)
    got = de.sample_pca(vst, ntop=20).orderBy("pc", "sample_id").collect()
    for pc in (1, 2):
        mine = np.array([r["score"] for r in got if r["pc"] == pc])
        theirs = vt[pc - 1] * d[pc - 1]
        assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-8)
        assert {r["percent_var"] for r in got if r["pc"] == pc} == {float(round(100 * d[pc - 1] ** 2 / (d**2).sum()))}


def test_rna_and_dna_flows(spark, tmp_path):
    rng = random.Random(12)
    genome = "".join(rng.choice("ACGT") for _ in range(6000))
    chunk, overlap = 500, 128
    reference = spark.createDataFrame(
        [("c1", s, genome[s : s + chunk + overlap]) for s in range(0, len(genome), chunk)], "chrom string, start0 bigint, bases string"
    )
    rows, variant = [], 2100
    for s in range(4):
        for i in range(400):
            start = rng.randrange(5900) if i % 4 else rng.randrange(2050, 2100)
            seq = list(genome[start : start + 80])
            if s == 0 and start <= variant < start + 80:
                seq[variant - start] = "A" if genome[variant] != "A" else "C"
            rows.append((f"S{s}", 0, i, f"r{s}_{i}", "".join(seq), [38] * len(seq)))
    reads = spark.createDataFrame(rows, READS)
    samples = spark.createDataFrame([(f"S{s}", "a" if s < 2 else "b", "b1") for s in range(4)], "sample_id string, condition string, batch string")
    features = spark.createDataFrame(
        [("c1", "exon", f"G{g}", g * 500 + 1, g * 500 + 400, "+") for g in range(12)],
        "chrom string, feature string, gene_id string, start_pos bigint, end_pos bigint, strand string",
    )
    mapper = lambda r: mapping.map_reads(r, reference, 16, 2, chunk, overlap)
    rna = flows.run_rna(str(tmp_path), "rna1", reads, samples, features, mapper)
    report = rna["report"].first()
    assert report["samples_processed"] == 4 and report["pc1_variance"] == "n/a"
    assert {r["status"] for r in rna["status"].collect()} == {"complete"}
    assert rna["counts"].agg(F.sum("cnt")).first()[0] > 1000
    panel = spark.createDataFrame([("c1", 2000, 2200, "hot")], "chrom string, start0 bigint, end0 bigint, name string")
    known = spark.createDataFrame([("c1", 17)], "chrom string, pos bigint")
    dna = flows.run_dna(str(tmp_path), "dna1", reads, samples, reference, chunk, mapper, known, panel, features, threshold=5)
    called = [(r["sample_id"], r["pos"], r["gt"]) for r in dna["calls"].collect()]
    assert called == [("S0", variant + 1, "1/1")]
    assert dna["variants"].first()["gene"] == "G4"
    assert {r["passed"] for r in dna["coverage_gate"].collect()} == {True}
    assert dna["report"].count() == 1


def test_retry_of_failed_alignment(spark, tmp_path):
    """A sample that fails the gate and is advised to be trimmed again is aligned exactly once more."""
    rows = [("S0", 0, i, f"a{i}", "A" * 60, [40] * 60) for i in range(10)] + [("S1", 0, i, f"b{i}", "C" * 60, [40] * 60) for i in range(10)]
    reads = spark.createDataFrame(rows, READS)
    calls = []

    def mapper(r):
        calls.append(1)
        flag = F.when((F.col("sample_id") == "S1") & F.lit(len(calls) == 1), 4).otherwise(0)
        return r.withColumn("flag", flag)

    advice = spark.createDataFrame([("S1", "re_trim", 5, 5, "4:22", 40)], "sample_id string, action string, leading_q int, trailing_q int, sliding string, min_len int")
    run = flows.Run(str(tmp_path), "r1")
    aligned, gate = flows.align_with_retry(run, reads, reads, mapper, advice)
    assert len(calls) == 2 and aligned.count() == 20
    assert {(r["sample_id"], r["status"]) for r in gate.collect()} == {("S0", "pass"), ("S1", "pass")}
