"""What read QC and FASTQ writing compute for a read, and how often."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import seqframe.plans.catalog  # noqa: F401  (registers every query)
from seqframe.fixtures import view
from seqframe.functions.quality import encode_phred33
from seqframe.operators import qc
from seqframe.plans.registry import QUERIES
from seqframe.schemas import READS
from seqframe.sources import sinks

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_reads() -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([0, 1, 7, 30, 31])
        quals = [rng.choice([2, 17, 40, None, 93]) for _ in range(max(0, n + rng.choice([0, 0, 0, -1, 2])))]
        seq = "".join(rng.choice("ACGTNé.") for _ in range(n))
        rows.append((rng.choice(["a", "b", None]), 1, i, f"r{i}", None if i % 41 == 3 else seq, None if i % 37 == 5 else quals))
    return rows + [("long", 1, 1, "x", "ACGTN" * 3_000, [7] * 15_000), ("far", 1, 2, "y", "AC" * 500, [-5, 2_000_000_000] * 500)]


def test_base_profile_counts_every_base_once(spark, monkeypatch):
    """Empty reads have no bases; the shorter of sequence and qualities ends in NULLs."""
    monkeypatch.setattr(qc, "BASES_AT_ONCE", 500)
    rows = odd_reads()
    want = Counter()
    for sample, _, _, _, seq, quals in rows:
        for p in range(max(len(seq), len(quals)) if seq is not None and quals is not None else 0):
            want[sample, p + 1, quals[p] if p < len(quals) else None, seq[p] if p < len(seq) else None] += 1
    whole = Counter()
    letters = Counter()
    for (sample, pos, q, base), n in want.items():
        whole[sample, pos, q] += n
        letters[sample, pos, q, base] += n
    out = qc.base_profile(spark.createDataFrame(rows, READS).repartition(3)).collect()
    assert {(r.sample_id, r.pos, r.q): r.n for r in out} == dict(whole) and len(out) == len(whole)
    for r in out:
        assert all(r[f"n_{b.lower()}"] == letters[r.sample_id, r.pos, r.q, b] for b in "ACGTN")


def test_read_numbers_by_hand(spark):
    rows, want = odd_reads(), Counter()
    for sample, _, _, _, seq, quals in rows:
        if seq is None:
            continue
        called, gc = sum(c in "ACGT" for c in seq), sum(c in "GC" for c in seq)
        want[sample, "length", len(seq)] += 1
        if seq and quals is not None and None not in quals:
            want[sample, "mean_q", sum(quals) // len(seq)] += 1
        if called:
            want[sample, "gc_pct", (200 * gc + called) // (2 * called)] += 1
        if "GAT" in seq:
            want[sample, "adapter x", seq.index("GAT") + 1] += 1
    out = qc.read_numbers(spark.createDataFrame(rows, READS).repartition(3), {"x": "GAT"}).collect()
    assert {(r.sample_id, r.kind, r.value): r.n for r in out} == dict(want)


def test_qualities_are_made_only_where_they_are_read(spark):
    assert "quals" not in plan_of(view(spark, SF, "reads").select("sample_id", "seq"))
    for name in ("qc_basic_stats", "qc_overrepresented_sequences", "qc_duplication_rate", "qc_length_distribution"):
        assert "quals" not in plan_of(QUERIES[name](spark, SF)), name


def test_flags_and_summary_take_the_documents_apart_once(spark):
    for name in ("qc_flags", "qc_sample_verdict", "qc_summary"):
        assert "documents.parquet" not in plan_of(QUERIES[name](spark, SF)), name
        assert "posexplode" not in plan_of(QUERIES[name](spark, SF)), name


def test_encoded_qualities_are_those_of_char(spark):
    rows = [([0, 40, 93, 94, 200, 222, 223, 300, -33, -40, None, 5],), (None,), ([],), ([None],), ([2, 3],)] * 3
    quals = spark.createDataFrame(rows, "quals array<int>").repartition(2)
    by_char = F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")
    out = quals.select(encode_phred33(F.col("quals")).alias("a"), by_char.alias("b")).collect()
    assert len(out) == 15 and all(r.a == r.b for r in out), [(r.a, r.b) for r in out]


def test_fastq_records_are_text_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """No array of qualities goes through the shuffle."""
    dealt = []
    frame = type(spark.range(1))
    keep = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *a: dealt.append(df.columns) or keep(df, *a))
    sinks.write_fastq(spark.createDataFrame([("a", 1, i, f"r{i}", "ACGT", [2, 40, 40, 2]) for i in range(9)], READS), str(tmp_path), compression="none")
    assert dealt and all("quals" not in c for c in dealt)
    assert [r.value for r in spark.read.text(f"{tmp_path}/*/*/*/*").limit(4).collect()] == ["@r0", "ACGT", "+", "#II#"]
