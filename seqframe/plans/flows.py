"""The two branches end to end, over all samples of a run at once.

Each stage is stored under ``base/stage=<stage>/run_id=<run_id>`` and read back,
so a stage is computed once, survives lost executors and can be inspected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.operators import alignments as al
from seqframe.operators import counts as ct
from seqframe.operators import coverage as cv
from seqframe.operators import de, decide, enrich, pileup, qc, recalibrate, runs, trim
from seqframe.operators import variants as vr
from seqframe.operators.decide import PARAMS
from seqframe.sources.sinks import write_run

Mapper = Callable[[DataFrame], DataFrame]
MAX_ALIGN_ATTEMPTS = 2


class Run:
    """Where a run keeps its stage tables."""

    def __init__(self, base: str, run_id: str):
        self.base, self.run_id = base, run_id

    def store(self, stage: str, table: DataFrame) -> DataFrame:
        write_run(table, self.base, self.run_id, stage)
        plain = table.drop("run_id")
        return table.sparkSession.read.schema(plain.schema).parquet(f"{self.base}/stage={stage}/run_id={self.run_id}")


def read_stages(run: Run, reads: DataFrame) -> dict[str, DataFrame]:
    """QC flags and verdicts, trim decisions, and reads trimmed where needed."""
    flags = run.store("qc", qc.qc_flags(reads))
    decisions = run.store("trim_decision", decide.trim_decision(flags, reads))
    trimmed = run.store("trim", trim.trim_where_needed(reads, decisions))
    return {"qc_flags": flags, "verdicts": decide.qc_verdict(flags), "decisions": decisions, "trimmed": trimmed}


def align_with_retry(
    run: Run, raw: DataFrame, trimmed: DataFrame, mapper: Mapper, advice: DataFrame | None = None, minimum: float = decide.MIN_MAPPING_RATE
) -> tuple[DataFrame, DataFrame]:
    """Alignments and gate. A failing sample whose advice (sample_id, action, trim parameters) is
    ``re_trim`` is trimmed again from its raw reads and aligned once more."""
    aligned = run.store("align_1", mapper(trimmed))
    gate = run.store("gate_1", decide.alignment_gate(al.mapping_rate(aligned, digits=None), advice, minimum))
    if advice is None:
        return aligned, gate
    for attempt in range(2, MAX_ALIGN_ATTEMPTS + 1):
        again = trim.retrim_failed(raw, gate, advice.select("sample_id", *PARAMS))
        redone = run.store(f"align_{attempt}", mapper(again))
        second = decide.alignment_gate(al.mapping_rate(redone, digits=None), advice, minimum)
        names = redone.select("sample_id").distinct()
        aligned = aligned.join(names, "sample_id", "left_anti").unionByName(redone)
        gate = run.store(f"gate_{attempt}", gate.join(names, "sample_id", "left_anti").unionByName(second))
    return aligned, gate


def run_rna(
    base: str,
    run_id: str,
    reads: DataFrame,
    samples: DataFrame,
    features: DataFrame,
    mapper: Mapper,
    gene_terms: DataFrame | None = None,
    advice: DataFrame | None = None,
    minimum: float = decide.MIN_MAPPING_RATE,
) -> dict[str, DataFrame]:
    """Reads to counts, differential expression, enrichment and the run report."""
    run = Run(base, run_id)
    out = read_stages(run, reads)
    aligned, gate = align_with_retry(run, reads, out["trimmed"], mapper, advice, minimum)
    passed = gate.filter("status = 'pass'").select("sample_id")
    keyed = aligned.withColumn("aln_id", F.concat_ws("/", "read_id", F.col("mate").cast("string")))
    assigned = run.store("assign", ct.assign_reads(keyed.join(passed, "sample_id", "left_semi"), features))
    counts = run.store("count", ct.feature_counts(assigned, features))
    results = run.store("de", de.differential_expression(counts, samples))
    summary = de.de_summary(results)
    out |= {"alignments": aligned, "gate": gate, "assigned": assigned, "counts": counts, "de": results}
    evidence = None
    if gene_terms is not None:
        genes = enrich.significant_genes(results)
        out["go"] = run.store("go", enrich.go_enrichment(genes, gene_terms))
        evidence = enrich.evidence(out["go"], genes)
    no_halts = samples.limit(0).select("sample_id", F.lit("").alias("stage"), F.lit("").alias("reason"))
    status = runs.sample_status(samples, no_halts, gate, out["decisions"].filter("trim")).withColumn("run_id", F.lit(run_id))
    verdicts = out["verdicts"].select("sample_id", "verdict", "confidence")
    out["status"] = status
    out["report"] = runs.run_report(status, summary, evidence, qc=verdicts, count=ct.assignment_summary(assigned))
    return out


def run_dna(
    base: str,
    run_id: str,
    reads: DataFrame,
    samples: DataFrame,
    reference: DataFrame,
    chunk: int,
    mapper: Mapper,
    known_sites: DataFrame | None = None,
    panel: DataFrame | None = None,
    features: DataFrame | None = None,
    threshold: float | None = None,
) -> dict[str, DataFrame]:
    """Reads to duplicates, recalibration (given known sites), calls, annotation, coverage gate and report."""
    run = Run(base, run_id)
    out = read_stages(run, reads)
    aligned = mapper(out["trimmed"]).withColumns({"qname": F.col("read_id"), "library": F.col("sample_id"), "read_group": F.col("sample_id")})
    marked = run.store("mark_duplicates", al.mark_duplicates(run.store("align", aligned)))
    out["duplication"] = al.duplication_metrics(marked)
    table = None
    if known_sites is not None:
        table = run.store("bqsr", recalibrate.base_recalibration_table(marked, reference, known_sites, chunk))
    final = run.store("final", recalibrate.apply_recalibration(marked, table))
    calls = run.store("call", pileup.call_variants(pileup.pileup(final), reference, chunk))
    rows = calls.select(
        "sample_id", "chrom", "pos", "ref", "alt", F.round("qual", 2).cast("string").alias("qual"), F.lit("PASS").alias("filter"),
        F.format_string("DP=%d;GT=%s;ALTS=%s", "dp", "gt", "alts").alias("info"),
    )
    variants = vr.annotation_fields(rows)
    if features is not None:
        placed = vr.annotate_regions(variants, features)
        placed = vr.consequences(placed, features, reference, chunk)
        variants = placed.withColumns({"gene": F.coalesce("region_gene", "gene"), "effect": F.coalesce("change", "region")}).drop("region", "region_gene", "change", "change_unit")
    out |= {"alignments": final, "calls": calls, "variants": run.store("variants", variants.select("sample_id", *vr.COLUMNS))}
    gate = decide.alignment_gate(al.mapping_rate(final, digits=None), minimum=0.0)
    halts = samples.limit(0).select("sample_id", F.lit("").alias("stage"), F.lit("").alias("reason"))
    extra = {"variants": vr.sample_variants(out["variants"])}
    if panel is not None:
        coverage = run.store("coverage", cv.region_mean_depth(cv.depth(final.withColumn("aln_id", F.col("read_id"))), panel, samples))
        checked = decide.coverage_gate(cv.panel_mean_depth(coverage), threshold=threshold)
        halts = checked.filter("halt").select("sample_id", F.lit("coverage_agent").alias("stage"), F.col("halt_reason").alias("reason"))
        extra["coverage"] = checked
        out |= {"coverage": coverage, "coverage_gate": checked}
    status = runs.sample_status(samples, halts, gate, out["decisions"].filter("trim")).withColumn("run_id", F.lit(run_id))
    out["status"] = status
    out["report"] = runs.run_report(status, None, None, qc=out["verdicts"].select("sample_id", "verdict", "confidence"), **extra)
    return out
