"""Verdicts and gates: small per-sample tables turned into decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions.skew import lookup_join

# Trim parameter sets (leading, trailing, sliding window, minimum length).
DEFAULT_TRIM = (3, 3, "4:20", 36)
MEDIUM_TRIM = (4, 4, "4:21", 38)
STRONG_TRIM = (5, 5, "4:22", 40)
MIN_MAPPING_RATE = 60.0
MIN_COVERAGE = 30.0

PARAMS = ("leading_q", "trailing_q", "sliding", "min_len")


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("sample_id").agg(
        F.count_if(F.col("status") == "FAIL").cast("int").alias("fails"),
        F.count_if(F.col("status") == "WARN").cast("int").alias("warns"),
    )


def _confidence(fail_weight: float = 0.1, extra_cap: float | None = 0.4) -> Column:
    extra = F.lit(fail_weight) * F.col("fails") + F.lit(0.03) * F.col("warns")
    if extra_cap is not None:
        extra = F.least(F.lit(extra_cap), extra)
    return F.least(F.lit(0.95), F.lit(0.55) + extra)


def qc_verdict(flags: DataFrame) -> DataFrame:
    """pass / trim_required / fail per sample with a confidence and a one-line summary."""
    fails, warns = F.col("fails"), F.col("warns")
    return flag_counts(flags).select(
        "sample_id",
        "fails",
        "warns",
        F.when(fails >= 2, "fail").when((fails > 0) | (warns >= 3), "trim_required").otherwise("pass").alias("verdict"),
        F.round(_confidence(), 3).alias("confidence"),
        F.format_string("%d failures, %d warnings in FastQC modules.", fails, warns).alias("quality_summary"),
        F.format_string("judged by module flags alone: %d failed, %d raised a warning", fails, warns).alias("reasoning"),
    )


def _param_struct(values: tuple[int, int, str, int]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(PARAMS, values)])


def trim_decision(
    flags: DataFrame,
    samples: DataFrame | None = None,
    policy: str = "flags",
    user_params: DataFrame | None = None,
) -> DataFrame:
    """Whether and how to trim each sample.

    ``policy="flags"``: trim on any FAIL or three WARNs, medium parameters from
    four WARNs on; a sample of ``samples`` without flags is left untrimmed.
    ``policy="tool"``: medium parameters from three WARNs on, a slower-growing,
    unrounded confidence, and per-sample ``user_params`` win with confidence 1.
    """
    fails, warns = F.col("fails"), F.col("warns")
    counts = flag_counts(flags)
    if samples is not None:
        counts = samples.select("sample_id").distinct().join(counts, "sample_id", "left")
    if policy not in ("flags", "tool"):
        raise ValueError(f"unknown policy {policy}")
    medium_from = 4 if policy == "flags" else 3
    params = (
        F.when(fails >= 2, _param_struct(STRONG_TRIM))
        .when(warns >= medium_from, _param_struct(MEDIUM_TRIM))
        .otherwise(_param_struct(DEFAULT_TRIM))
    )
    if policy == "flags":
        unknown = fails.isNull()
        out = counts.select(
            "sample_id",
            F.coalesce((fails > 0) | (warns >= 3), F.lit(False)).alias("trim"),
            params.alias("p"),
            F.when(unknown, F.lit(0.45)).otherwise(F.round(_confidence(), 2)).alias("confidence"),
            F.lit("heuristic").alias("source"),
        )
        return out.select("sample_id", "trim", *[f"p.{n}" for n in PARAMS], "confidence", "source")
    fails, warns = F.coalesce(fails, F.lit(0)), F.coalesce(warns, F.lit(0))
    counts = counts.withColumn("fails", fails).withColumn("warns", warns)
    out = counts.select(
        "sample_id", params.alias("p"), _confidence(0.08, None).alias("confidence"), F.lit("heuristic").alias("source")
    )
    if user_params is None:
        return out.select("sample_id", *[f"p.{n}" for n in PARAMS], "confidence", "source")
    given = user_params.select("sample_id", *[F.col(n).alias(f"u_{n}") for n in PARAMS], F.lit(True).alias("given"))
    both = out.join(given, "sample_id", "left")
    default = dict(zip(PARAMS, DEFAULT_TRIM))
    chosen = [
        F.when(F.col("given"), F.coalesce(F.col(f"u_{n}"), F.lit(default[n]))).otherwise(F.col(f"p.{n}")).alias(n)
        for n in PARAMS
    ]
    return both.select(
        "sample_id",
        *chosen,
        F.when(F.col("given"), 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("given"), "user-supplied").otherwise(F.col("source")).alias("source"),
    )


def normalize_trim_params(requests: DataFrame) -> DataFrame:
    """Defaults for missing values, clamping, and all defaults where a number is not an integer."""
    default = dict(zip(PARAMS, DEFAULT_TRIM))
    bounds = {"leading_q": (0, 40), "trailing_q": (0, 40), "min_len": (36, 200)}
    asked = {n: F.coalesce(F.col(n).cast("string"), F.lit(str(default[n]))) for n in PARAMS}
    number = {n: asked[n].try_cast("int") for n in bounds}
    bad = F.lit(False)
    for value in number.values():
        bad = bad | value.isNull()
    fixed = [
        F.when(bad, F.lit(default[n])).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), number[n]))).alias(n)
        for n, (lo, hi) in bounds.items()
    ]
    window = F.when(~bad & asked["sliding"].rlike(r"^\d+:\d+$"), asked["sliding"]).otherwise(default["sliding"])
    return requests.select(
        *[c for c in requests.columns if c not in PARAMS], fixed[0], fixed[1], window.alias("sliding"), fixed[2]
    )


VERDICT_KEYS = ("verdict", "reasoning", "quality_summary", "confidence")

# Spellings accepted for a verdict.
FAIL_WORDS = ("fail", "failed", "unusable")
PASS_WORDS = ("pass", "passed", "good", "ok", "okay", "accept", "accepted")


def normalize_verdict(text: Column) -> Column:
    word = F.translate(F.lower(F.trim(text)), "- ", "__")
    return (
        F.when(word.isin(*FAIL_WORDS), "fail")
        .when(word.contains("trim"), "trim_required")
        .when(word.isin(*PASS_WORDS), "pass")
    )


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def parse_verdicts(
    verdicts: DataFrame, raw: str = "raw", most_reasoning: int | None = None, most_summary: int | None = None
) -> DataFrame:
    """Reviewer answers (free text around one JSON object) as columns; unusable ones give NULL.

    Texts stay whole unless a greatest length is asked for.
    """
    blob = F.nullif(F.regexp_extract(raw, r"\{[\s\S]*\}", 0), F.lit(""))
    parsed = F.from_json(blob, "map<string,string>")
    fields = verdicts.withColumn("_m", parsed)
    has_all = F.lit(True)
    for key in VERDICT_KEYS:
        has_all = has_all & F.coalesce(F.map_contains_key("_m", F.lit(key)), F.lit(False))
    confidence = F.try_element_at("_m", F.lit("confidence")).try_cast("double")
    verdict = F.when(has_all & confidence.isNotNull(), normalize_verdict(F.try_element_at("_m", F.lit("verdict"))))
    return fields.withColumn("ext_verdict", verdict).select(
        *[c for c in verdicts.columns if c != raw],
        "ext_verdict",
        F.when(
            F.col("ext_verdict").isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 3)
        ).alias("ext_confidence"),
        _cut(F.try_element_at("_m", F.lit("reasoning")), most_reasoning).alias("ext_reasoning"),
        _cut(F.try_element_at("_m", F.lit("quality_summary")), most_summary).alias("ext_summary"),
    )


def merge_external_verdicts(heuristic: DataFrame, verdicts: DataFrame, key: str = "sample_id") -> DataFrame:
    """Prefer a usable external verdict, else keep the heuristic one."""
    ext = parse_verdicts(verdicts).filter(F.col("ext_verdict").isNotNull()).withColumn("_used", F.lit(True))
    both = heuristic.join(ext, key, "left")
    used = F.coalesce("_used", F.lit(False))

    def pick(theirs: str, ours: str) -> Column:
        return F.when(used, F.col(theirs)).otherwise(F.col(ours)).alias(ours)

    return both.select(
        key,
        pick("ext_verdict", "verdict"),
        pick("ext_confidence", "confidence"),
        pick("ext_reasoning", "reasoning"),
        pick("ext_summary", "quality_summary"),
        F.when(used, "external").otherwise("heuristic").alias("source"),
    )


def alignment_gate(rates: DataFrame, actions: DataFrame | None = None, minimum: float = MIN_MAPPING_RATE) -> DataFrame:
    """fail below the minimum mapping rate; a failing sample gets its supplied action, else abort."""
    failed = F.col("mapping_rate") < minimum
    out = rates if actions is None else rates.join(actions.select("sample_id", "action"), "sample_id", "left")
    action = F.lit("abort") if actions is None else F.coalesce("action", F.lit("abort"))
    return out.select(
        "sample_id",
        F.round("mapping_rate", 2).alias("mapping_rate"),
        F.when(failed, "fail").otherwise("pass").alias("status"),
        F.when(failed, action).alias("action"),
    )


def coverage_gate(depths: DataFrame, keys: Sequence[str] = ("sample_id",), threshold: float | str | None = None) -> DataFrame:
    """ok at or above the threshold; else warn and halt. A missing depth halts too, with its own reason."""
    limit = F.coalesce(F.nullif(F.lit(threshold).try_cast("double"), F.lit(0.0)), F.lit(MIN_COVERAGE))
    depth = F.col("mean_depth").try_cast("double")
    passed = F.coalesce(depth >= limit, F.lit(False))
    return depths.select(
        *keys,
        F.round(depth, 3).alias("mean_depth"),
        limit.alias("threshold"),
        passed.alias("passed"),
        F.when(passed, "ok").otherwise("warn").alias("status"),
        (~passed).alias("halt"),
        F.when(depth.isNull(), "Coverage not available")
        .when(~passed, "Coverage below threshold")
        .otherwise("")
        .alias("halt_reason"),
    )


def attach_params(reads: DataFrame, decisions: DataFrame) -> DataFrame:
    """Trim parameters of each read's sample; the defaults where it has none."""
    joined = lookup_join(reads, decisions.select("sample_id", *PARAMS), ["sample_id"], "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(PARAMS, DEFAULT_TRIM)})
