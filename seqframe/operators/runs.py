"""Run tables: stage results, halts, sample status, artifact verification and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages in the order they run, for either branch.
STAGES = ("ingest", "qc", "ai_decider", "trim", "align", "bwa_agent", "gatk_agent", "annotate_agent", "coverage_agent",
          "count", "de_agent", "insight_agent", "report_builder", "report_agent")


def parse_stage_results(raw: DataFrame, column: str = "result") -> DataFrame:
    """Stage outputs as JSON text to columns, with payload values as text."""
    schema = "struct<status:string,payload:map<string,string>,reasoning:string,halt:boolean,halt_reason:string>"
    return raw.select(*[c for c in raw.columns if c != column], F.from_json(column, schema).alias("r")).select(
        *[c for c in raw.columns if c != column], "r.*"
    )


def normalize_stage_results(results: DataFrame) -> DataFrame:
    """Defaults for missing envelope fields; other columns stay."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    defaults = {
        "status": F.coalesce("status", F.lit("ok")),
        "reasoning": F.coalesce("reasoning", F.concat_ws(" ", "stage", F.lit("completed"))),
        "halt": F.coalesce("halt", F.lit(False)),
        "halt_reason": F.coalesce("halt_reason", F.lit("")),
    }
    if "payload" in results.columns:
        defaults["payload"] = F.coalesce("payload", empty)
    return results.withColumns(defaults)


def stage_order(stages: Sequence[str] = STAGES) -> Column:
    """0-based place of a stage; unknown stages come last."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    return F.when(place == 0, len(stages)).otherwise(place - 1).cast("int")


def first_halts(results: DataFrame, stages: Sequence[str] = STAGES, keys: Sequence[str] = ("run_id", "sample_id")) -> DataFrame:
    """The first halting stage of each sample and why."""
    reason = F.coalesce(
        F.nullif(F.col("halt_reason"), F.lit("")),
        F.nullif(F.col("reasoning"), F.lit("")),
        F.concat_ws(" ", "stage", F.lit("requested halt")),
    )
    first = F.min(F.struct(stage_order(stages).alias("order"), "stage", reason.alias("reason")))
    halted = results.filter("halt").groupBy(*keys).agg(first.alias("first"))
    return halted.select(
        *keys, F.lit("halted").alias("status"), F.col("first.stage").alias("stage"), F.col("first.reason").alias("reason")
    )


def halt_gate(results: DataFrame, stages: Sequence[str] = STAGES, keys: Sequence[str] = ("run_id", "sample_id")) -> DataFrame:
    """Stage results without those that come after a sample's first halt."""
    halts = first_halts(results, stages, keys).select(*keys, F.col("stage").alias("_halt"))
    both = results.join(halts, list(keys), "left")
    halted_at = stage_order(stages)
    limit = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("_halt")) - 1
    limit = F.when(limit < 0, len(stages)).otherwise(limit)
    return both.filter(F.col("_halt").isNull() | (halted_at <= limit)).drop("_halt")


def sample_status(
    samples: DataFrame, halts: DataFrame, gate: DataFrame, trimmed: DataFrame, artifacts: DataFrame | None = None
) -> DataFrame:
    """complete, halted or failed_at_alignment per sample with trim flag, mapping rate and artifact count."""
    out = (
        samples.select("sample_id")
        .distinct()
        .join(halts.select("sample_id", F.col("stage").alias("halt_stage"), F.col("reason").alias("halt_reason")), "sample_id", "left")
        .join(gate.select("sample_id", "mapping_rate", F.col("status").alias("_gate")), "sample_id", "left")
        .join(trimmed.select("sample_id").distinct().withColumn("_trim", F.lit(True)), "sample_id", "left")
    )
    before_align = F.col("halt_stage").isin("ingest", "qc", "ai_decider", "trim")
    status = (
        F.when(before_align, "halted")
        .when(F.col("_gate") == "fail", "failed_at_alignment")
        .when(F.col("halt_stage").isNotNull(), "halted")
        .otherwise("complete")
    )
    columns = ["sample_id", status.alias("status"), "halt_stage", "halt_reason", "mapping_rate", F.coalesce("_trim", F.lit(False)).alias("trim_was_run")]
    if artifacts is not None:
        out = out.join(artifacts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")), "sample_id", "left")
        columns.append(F.coalesce("_n", F.lit(0)).alias("n_artifacts"))
    return out.select(*columns)


def successful_samples(status: DataFrame, experiment: Column | str = "RNA-Seq") -> DataFrame:
    """Samples that completed in an RNA run."""
    kind = F.lit(experiment) if isinstance(experiment, str) else experiment
    return status.filter((F.col("status") == "complete") & ~kind.isin("WGS", "WES")).select("sample_id")


def verify_artifacts(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Issues of each run: failed steps (error) and expected artifacts nobody produced (warning).

    ``expected``: run_id, step, artifact. ``outcomes``: run_id, step, returncode, artifact (NULL if none).
    """
    failed = outcomes.filter("returncode <> 0").select("run_id", "step", "returncode").distinct()
    errors = failed.select(
        "run_id",
        F.lit("error").alias("severity"),
        F.format_string("step %s ended with exit code %d", "step", "returncode").alias("message"),
    )
    produced = outcomes.filter("artifact is not null").select("run_id", "artifact").distinct()
    missing = expected.select("run_id", "artifact").distinct().join(produced, ["run_id", "artifact"], "left_anti")
    warnings = missing.select(
        "run_id",
        F.lit("warning").alias("severity"),
        F.format_string("no step produced %s", "artifact").alias("message"),
    )
    return errors.unionByName(warnings)


def verification_metrics(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """passed and the planned, executed, expected and observed counts per run."""
    plan = expected.groupBy("run_id").agg(
        F.countDistinct("step").alias("planned_steps"), F.countDistinct("artifact").alias("expected_artifacts")
    )
    done = outcomes.groupBy("run_id").agg(
        F.countDistinct("step").alias("executed_steps"),
        F.countDistinct("artifact").alias("observed_artifacts"),
        (F.count_if(F.col("returncode") != 0) == 0).alias("passed"),
    )
    numbers = ("planned_steps", "executed_steps", "expected_artifacts", "observed_artifacts")
    return plan.join(done, "run_id", "full").select(
        "run_id", F.coalesce("passed", F.lit(True)).alias("passed"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]
    )


def run_summary(status: DataFrame) -> DataFrame:
    """Samples processed and how they ended, per run."""
    return status.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples_processed"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("complete", "halted", "failed_at_alignment")],
    )


def run_report(
    status: DataFrame,
    de_summary: DataFrame | None = None,
    evidence: DataFrame | None = None,
    **per_sample: DataFrame,
) -> DataFrame:
    """One record per run: headline numbers and the sample rows with their QC, alignment, ... structs.

    ``per_sample`` tables (qc=..., align=..., count=..., coverage=...) have one row
    per sample; sample rows stay rows until the last grouping, which holds as
    many entries as the run has samples.
    """
    rows = status
    for name, table in per_sample.items():
        packed = table.select("sample_id", F.struct(*[c for c in table.columns if c != "sample_id"]).alias(name))
        rows = rows.join(packed, "sample_id", "left")
    sample = F.struct(*[c for c in rows.columns if c != "run_id"])
    report = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples_processed"), F.sort_array(F.collect_list(F.to_json(sample))).alias("samples")
    )
    if de_summary is not None:
        report = report.join(F.broadcast(de_summary))  # one row
    n_sig = F.col("n_sig") if "n_sig" in report.columns else F.lit(None)
    pc1 = F.col("pc1_variance").cast("string") if "pc1_variance" in report.columns else F.lit(None)
    report = report.withColumns(
        {"n_sig": F.coalesce(n_sig.cast("bigint"), F.lit(0)), "pc1_variance": F.coalesce(pc1, F.lit("n/a"))}
    )
    return report if evidence is None else report.join(F.broadcast(evidence))  # one row
