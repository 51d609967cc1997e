"""Checks of sample sheet and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.operators import de, runs
from seqframe.operators import samples as sm
from seqframe.operators.alignments import mapping_rate
from seqframe.operators.decide import alignment_gate
from seqframe.plans.registry import query

STAGE_ORDER = "list_position(['ingest','qc','ai_decider','trim','align','bwa_agent','gatk_agent','annotate_agent','coverage_agent','count'], stage)-1"
NORMAL = """norm as (select run_id, sample_id, event_id, stage, coalesce(status,'ok') status, coalesce(reasoning, concat(stage,' completed')) reasoning,
 coalesce(halt,false) halt, coalesce(halt_reason,'') halt_reason, returncode from stage_results)"""
HALTS = f"""{NORMAL}, halts as (select run_id, sample_id, min(({STAGE_ORDER}, stage, coalesce(nullif(halt_reason,''),nullif(reasoning,''),concat(stage,' requested halt')))) m
 from norm where halt group by 1,2)"""
STATUS = f"""{HALTS.replace("stage_results", "user_results")}, h1 as (select sample_id, min(({STAGE_ORDER}, stage, coalesce(nullif(halt_reason,''),nullif(reasoning,''),concat(stage,' requested halt')))) m
 from norm where halt group by 1),
 names as (select distinct sample_id, concat('S',cast(substr(sample_id,2) as bigint)%6+1) lane from norm),
 rates as (select names.sample_id, rate from names join (select sample_id lane, 100.0*count(*) filter (flag&4=0)/count(*) rate from alignments where flag&2304=0 group by 1) r using (lane)),
 status as (select s.sample_id, case when m[2] in ('ingest','qc','ai_decider','trim') then 'halted' when rate<83.3 then 'failed_at_alignment' when m is not null then 'halted' else 'complete' end status,
 m[2] halt_stage, m[3] halt_reason, round(rate,2) mapping_rate, t.sample_id is not null trim_was_run, coalesce(n,0) n_artifacts
 from names s left join h1 using (sample_id) left join rates using (sample_id) left join (select distinct sample_id from norm where stage='trim') t using (sample_id)
 left join (select sample_id, count(*) n from norm group by 1) a using (sample_id))"""


def _normal(v):
    return runs.normalize_stage_results(v("stage_results"))


def _lanes(v):
    """The samples of the results by user, each with the sample whose reads stand for it."""
    return v("user_results").select("sample_id").distinct().withColumn("lane", F.expr("concat('S', cast(substr(sample_id, 2) as bigint) % 6 + 1)"))


def _status(v):
    results, lanes = runs.normalize_stage_results(v("user_results")), _lanes(v)
    rates = mapping_rate(v("alignments"), digits=None).withColumnRenamed("sample_id", "lane").join(lanes, "lane").drop("lane")
    halts = runs.first_halts(results, keys=("sample_id",))
    return runs.sample_status(lanes, halts, alignment_gate(rates, minimum=83.3), results.filter("stage = 'trim'"), results)


@query("duplicate_samples", "sheet", "select coalesce(sample_id,'') sample_id, count(*) n from sheet group by 1 having count(*)>1")
def _(v):
    return sm.duplicate_samples(v("sheet"))


def _validation(paired: bool) -> str:
    fastq = (
        "coalesce(fastq_r1,'')='' or coalesce(fastq_r2,'')=''" if paired else "coalesce(fastq,'')=''"
    )
    text = "lacks a file of its read pair" if paired else "names no FASTQ file"
    columns = ("fastq_r1", "fastq_r2") if paired else ("fastq",)
    paths = " union all ".join(
        f"select row_no, sample_id, 'path', concat('row ',row_no,': nothing to read at {c}, ',{c}) from sheet where coalesce({c},'')<>'' and {c} not in (select path from present)"
        for c in columns
    )
    run = ("'gtf','an RNA run needs gene features (gtf)'" if paired else "'reference_fasta','a DNA run needs a reference sequence (reference_fasta)'")
    return f"""with present as (select concat(c_name,suffix) path from customer, (values ('.fastq'),('_1.fastq'),('_2.fastq')) s(suffix) where c_acctbal>=0)
 select row_no, sample_id, 'sample_id' as "rule", concat('row ',row_no,' has no sample_id') message from sheet where coalesce(sample_id,'')=''
 union all select row_no, sample_id, 'fastq', concat('row ',row_no,' {text}') from sheet where {fastq}
 union all select 0, sample_id, 'duplicate', concat(count(*),' rows are named ',sample_id) from sheet group by sample_id having count(*)>1
 union all {paths} union all select 0, null, {run}"""


def _present(v):
    customers = v.spark.read.parquet(f"{v.sf_dir}/customer.parquet").filter("c_acctbal >= 0")
    suffix = F.explode(F.array(*[F.lit(s) for s in (".fastq", "_1.fastq", "_2.fastq")]))
    return customers.select("c_name", suffix.alias("s")).select(F.concat("c_name", "s").alias("path"))


@query("validate_samples_paired", "sheet", _validation(True))
def _(v):
    return sm.validate_samples(v("sheet"), paired=True, experiment="RNA-Seq", organism="mouse", paths=_present(v))


@query("validate_samples_single", "sheet", _validation(False))
def _(v):
    return sm.validate_samples(v("sheet"), paired=False, experiment="WES", organism="mouse", paths=_present(v))


@query("validate_samples_empty_sheet", "", "select cast(0 as bigint) row_no, 'the sheet holds no sample' message")
def _(v):
    none = v("sheet").filter("row_no < 0")
    out = sm.validate_samples(none, paired=False, organism="mouse", gtf="genes.gtf")
    return out.select("row_no", "message")


@query("fill_sample_defaults", "sheet", """select row_no, sample_id, coalesce(condition,'unknown') condition, coalesce(replicate_group,'') replicate_group, coalesce(species,'human') species,
 fastq, fastq_r1, fastq_r2, concat('run-1-',sample_id) sample_run_id from sheet""")
def _(v):
    return sm.fill_sample_defaults(v("sheet"), "run-1", "human")


@query("normalize_stage_results", "stage_results", f"with {NORMAL} select * from norm")
def _(v):
    return _normal(v)


@query("parse_stage_results", "stage_results", """select event_id, case when event_id%3=0 then 'ok' else coalesce(status,'ok') end status,
 case when event_id%3=0 then concat(stage,' completed') else coalesce(reasoning, concat(stage,' completed')) end reasoning,
 case when event_id%3=0 then false else halt end halt, case when event_id%3=0 then '' else halt_reason end halt_reason,
 case when event_id%3=0 then null else cast(returncode as varchar) end code from stage_results""")
def _(v):
    whole = F.struct("status", F.struct("returncode").alias("payload"), "reasoning", "halt", "halt_reason")
    raw = v("stage_results").select("event_id", "stage", F.when(F.expr("event_id % 3 = 0"), F.lit("{}")).otherwise(F.to_json(whole)).alias("result"))
    out = runs.normalize_stage_results(runs.parse_stage_results(raw))
    code = F.try_element_at("payload", F.lit("returncode"))
    return out.select("event_id", "status", "reasoning", "halt", "halt_reason", code.alias("code"))


@query("first_halts", "stage_results", f"with {HALTS} select run_id, sample_id, 'halted' status, m[2] stage, m[3] reason from halts")
def _(v):
    return runs.first_halts(_normal(v))


@query("halt_gate", "stage_results", f"""with {HALTS} select n.* from norm n left join halts h using (run_id, sample_id) where m is null or {STAGE_ORDER}<=m[1]""")
def _(v):
    return runs.halt_gate(_normal(v))


@query("sample_status", "user_results alignments", f"with {STATUS} select * from status")
def _(v):
    return _status(v)


@query("successful_samples", "user_results alignments", f"with {STATUS} select sample_id from status where status='complete'")
def _(v):
    return runs.successful_samples(_status(v))


VERIFY = """expected as (select distinct concat('run',user_id%7) run_id, event_type step, concat(event_type,'-',user_id%50,'.out') artifact from events),
 outcomes as (select concat('run',user_id%7) run_id, event_type step, case when event_id%401=0 then 1 else 0 end returncode,
 case when value>=4 then concat(event_type,'-',user_id%50,'.out') end artifact from events where event_type<>'error')"""


def _verification(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    run, name = F.expr("concat('run', user_id % 7)"), F.expr("concat(event_type, '-', user_id % 50, '.out')")
    expected = events.select(run.alias("run_id"), F.col("event_type").alias("step"), name.alias("artifact")).distinct()
    outcomes = events.filter("event_type <> 'error'").select(
        run.alias("run_id"),
        F.col("event_type").alias("step"),
        F.expr("case when event_id % 401 = 0 then 1 else 0 end").alias("returncode"),
        F.when(F.col("value") >= 4, name).alias("artifact"),
    )
    return expected, outcomes


@query("verify_artifacts", "", f"""with {VERIFY} select distinct run_id, 'error' severity, concat('step ',step,' ended with exit code ',returncode) message from outcomes where returncode<>0
 union all select run_id, 'warning', concat('no step produced ',artifact) from (select run_id, artifact from expected except select run_id, artifact from outcomes)""")
def _(v):
    return runs.verify_artifacts(*_verification(v))


@query("verification_metrics", "", f"""with {VERIFY} select run_id, coalesce(bool_and(returncode=0),true) passed, any_value(p) planned_steps, count(distinct step) executed_steps,
 any_value(x) expected_artifacts, count(distinct artifact) observed_artifacts from outcomes full join (select run_id, count(distinct step) p, count(distinct artifact) x from expected group by 1) using (run_id) group by 1""")
def _(v):
    return runs.verification_metrics(*_verification(v))


@query("run_summary", "stage_results", f"""with {HALTS}, s as (select distinct run_id, sample_id from norm) select run_id, count(*) samples_processed, count(*) filter (m is null) n_complete,
 count(*) filter (m is not null) n_halted, cast(0 as bigint) n_failed_at_alignment from s left join halts using (run_id, sample_id) group by 1""")
def _(v):
    results = _normal(v)
    halts = runs.first_halts(results)
    status = results.select("run_id", "sample_id").distinct().join(halts, ["run_id", "sample_id"], "left")
    return runs.run_summary(status.withColumn("status", F.coalesce("status", F.lit("complete"))))


@query("run_report", "user_results alignments reads de_raw", f"""with {STATUS}, q as (select names.sample_id, n_reads from names join (select sample_id lane, count(*) n_reads from reads group by 1) r using (lane)),
 ranked as (select *, row_number() over (order by pvalue) rk, count(*) over () n from de_raw where pvalue is not null),
 adj as (select gene, least(1.0, min(pvalue*n/rk) over (order by pvalue desc, rk desc rows between unbounded preceding and current row)) padj from ranked)
 select 'run-1' run_id, (select count(*) from status) samples_processed,
 (select string_agg(concat(sample_id,' ',status,' ',n_reads,' ',mapping_rate), ';' order by sample_id) from status join q using (sample_id)) samples,
 (select count(*) from adj where padj<0.05) n_sig, 'n/a' pc1_variance""")
def _(v):
    status = _status(v).withColumn("run_id", F.lit("run-1"))
    summary = de.de_summary(de.de_results(v("de_raw"))).select("n_sig")
    counts = v("reads").groupBy(F.col("sample_id").alias("lane")).agg(F.count(F.lit(1)).alias("n_reads")).join(_lanes(v), "lane").drop("lane")
    report = runs.run_report(status, summary, qc=counts)
    schema = "sample_id string, status string, mapping_rate double, qc struct<n_reads:bigint>"
    line = F.transform("samples", lambda s: F.from_json(s, schema))
    text = F.transform(
        line,
        lambda s: F.concat_ws(" ", s["sample_id"], s["status"], s["qc"]["n_reads"].cast("string"), s["mapping_rate"].cast("string")),
    )
    return report.withColumn("samples", F.array_join(F.sort_array(text), ";"))
