"""Checks of the read QC and decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.operators import decide, qc
from seqframe.plans.registry import query

# short sequences that do occur in the test reads
TEST_ADAPTERS = {"first": "ACGTA", "second": "GATTAC", "third": "CCGNA"}

BASES = """bases as (select sample_id, p pos, substr(seq,cast(p as int),1) base, quals[p] q
 from (select sample_id, seq, quals, unnest(range(1,length(seq)+1)) p from reads)),
 base_profile as (select sample_id, pos, base, q, count(*) n from bases group by all)"""
PER_READ = """per_read as (select sample_id, seq, length(seq) length, list_sum(quals)//length(seq) mean_q,
 length(regexp_replace(seq,'[^GC]','','g')) gc, length(regexp_replace(seq,'[^ACGT]','','g')) called from reads)"""
QUALITY = """ranked as (select sample_id, pos, q, n, sum(n) over (partition by sample_id,pos order by q) cum,
 sum(n) over (partition by sample_id,pos) total from (select sample_id,pos,q,sum(n) n from base_profile group by all)),
 quality as (select sample_id, pos, cast(max(total) as bigint) n_reads, round(cast(sum(q*n) as double)/max(total),4) mean,
 min(case when cum*100>=total*50 then q end) median, min(case when cum*100>=total*25 then q end) lower_quartile,
 min(case when cum*100>=total*75 then q end) upper_quartile, min(case when cum*100>=total*10 then q end) p10,
 min(case when cum*100>=total*90 then q end) p90 from ranked group by 1,2)"""
CONTENT = """content as (select sample_id, pos, round(100.0*a/c,4) pct_a, round(100.0*cc/c,4) pct_c, round(100.0*g/c,4) pct_g,
 round(100.0*t/c,4) pct_t, round(100.0*nn/total,4) pct_n
 from (select sample_id, pos, cast(sum(case when base='A' then n else 0 end) as double) a,
 cast(sum(case when base='C' then n else 0 end) as double) cc, cast(sum(case when base='G' then n else 0 end) as double) g,
 cast(sum(case when base='T' then n else 0 end) as double) t, cast(sum(case when base='N' then n else 0 end) as double) nn,
 nullif(cast(sum(case when base<>'N' then n else 0 end) as double),0) c, cast(sum(n) as double) total from base_profile group by 1,2))"""
GC = """observed as (select sample_id, (200*gc+called)//(2*called) gc_pct, count(*) n from per_read where called>0 group by 1,2),
 centre as (select sample_id, sum(n) total, first(gc_pct order by n desc, gc_pct) mode from observed group by 1),
 spread as (select o.sample_id, any_value(total) total, any_value(mode) mode,
 sqrt(cast(sum(n*(gc_pct-mode)*(gc_pct-mode)) as double)/(any_value(total)-1)) sd from observed o join centre c using (sample_id) group by 1),
 grid as (select sample_id, total, x gc_pct, exp(-((x-mode)/sd)*((x-mode)/sd)/2) weight from spread, range(0,101) r(x)),
 gc_table as (select g.sample_id, g.gc_pct, coalesce(o.n,0) n_reads,
 round(weight/sum(weight) over (partition by g.sample_id)*total,4) expected
 from grid g left join observed o on o.sample_id=g.sample_id and o.gc_pct=g.gc_pct)"""
DUP = """seq_counts as (select sample_id, seq, count(*) copies from reads group by 1,2)"""
ADAPTER = """starts as (select sample_id, adapter, instr(seq, pattern) pos from reads,
 (values ('first','ACGTA'),('second','GATTAC'),('third','CCGNA')) a(adapter,pattern)),
 totals as (select sample_id, count(*) total from reads group by 1),
 adapters as (select sample_id, adapter, cast(pos as bigint) pos, round(100.0*cast(cum as double)/total,4) cum_percent from
 (select sample_id, adapter, pos, sum(count(*)) over (partition by sample_id, adapter order by pos) cum
 from starts where pos>0 group by 1,2,3) join totals using (sample_id))"""
FLAG_COUNTS = """f as (select sample_id, cast(count(*) filter (status='FAIL') as int) fails,
 cast(count(*) filter (status='WARN') as int) warns from module_flags group by 1)"""


@query("qc_read_count", "reads", """select sample_id, min(n) n_reads, count(*)>1 paired
 from (select sample_id, mate, count(*) n from reads group by 1,2) group by 1""")
def _(v):
    return qc.read_count(v("reads"))


@query("qc_basic_stats", "reads", f"""with {PER_READ} select sample_id, count(*) n_reads, cast(min(length) as bigint) min_length,
 cast(max(length) as bigint) max_length, round(100.0*cast(sum(gc) as double)/sum(called),4) pct_gc,
 case when min(length)=max(length) then cast(min(length) as varchar) else concat(min(length),'-',max(length)) end length_label,
 cast(max(length) as bigint) read_length from per_read group by 1""")
def _(v):
    out = qc.basic_stats(qc.read_profile(v("reads"), quality=False))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("min_length", "max_length", "read_length")})


@query("qc_per_base_quality", "reads", f"with {BASES}, {QUALITY} select * replace (cast(pos as int) as pos) from quality")
def _(v):
    return qc.per_base_quality(qc.base_profile(v("reads")))


@query("qc_per_sequence_quality", "reads",
       f"with {PER_READ} select sample_id, cast(mean_q as int) mean_q, count(*) n_reads from per_read where length>0 group by 1,2")
def _(v):
    return qc.per_sequence_quality(qc.read_profile(v("reads")))


@query("qc_per_base_content", "reads",
       f"with {BASES}, {CONTENT} select sample_id, cast(pos as int) pos, pct_a, pct_c, pct_g, pct_t from content")
def _(v):
    return qc.per_base_content(qc.base_profile(v("reads")))


@query("qc_per_sequence_gc", "reads",
       f"with {PER_READ}, {GC} select sample_id, cast(gc_pct as int) gc_pct, n_reads, expected from gc_table")
def _(v):
    return qc.per_sequence_gc(qc.read_profile(v("reads"), quality=False))


@query("qc_per_base_n", "reads", f"with {BASES}, {CONTENT} select sample_id, cast(pos as int) pos, pct_n from content")
def _(v):
    return qc.per_base_n(qc.base_profile(v("reads")))


@query("qc_length_distribution", "reads",
       "select sample_id, cast(length(seq) as int) length, count(*) n_reads from reads group by 1,2")
def _(v):
    return qc.length_distribution(qc.read_profile(v("reads"), quality=False))


@query("qc_duplication_levels", "reads", f"""with {DUP} select sample_id, case when copies>10000 then '>10000'
 when copies>5000 then '>5000' when copies>1000 then '>1000' when copies>500 then '>500' when copies>100 then '>100'
 when copies>50 then '>50' when copies>10 then '>10' when copies=10 then '>9' else cast(copies as varchar) end level_name, count(*) n_sequences,
 cast(sum(copies) as bigint) n_reads from seq_counts group by 1,2""")
def _(v):
    return qc.duplication_levels(qc.sequence_counts(v("reads"))).withColumnRenamed("level", "level_name")


@query("qc_duplication_rate", "reads", f"""with {DUP} select sample_id, count(*) n_distinct, cast(sum(copies) as bigint) n_reads,
 round(100.0*cast(sum(copies)-count(*) as double)/cast(sum(copies) as double),4) pct_duplicated from seq_counts group by 1""")
def _(v):
    return qc.duplication_rate(qc.sequence_counts(v("reads")))


@query("qc_overrepresented_sequences", "reads", f"""with {DUP} select sample_id, seq, copies, round(100.0*copies/total,4) as "percent"
 from (select *, cast(sum(copies) over (partition by sample_id) as double) total from seq_counts) where 100.0*copies/total > 0.1""")
def _(v):
    reads = v("reads")
    return qc.overrepresented_sequences(qc.sequence_counts(reads), materialize(qc.sample_totals(reads)))


@query("qc_adapter_content", "reads", f"with {ADAPTER} select * replace (cast(pos as int) as pos) from adapters")
def _(v):
    return qc.adapter_content(v("reads"), TEST_ADAPTERS)


FLAGS = f"""everyone as (select distinct sample_id from reads), {BASES}, {PER_READ}, {QUALITY}, {CONTENT}, {GC}, {DUP}, {ADAPTER},
 flags as (
 select e.sample_id, 'Basic Statistics' as module, 'PASS' status from everyone e
 union all select e.sample_id, 'Per base sequence quality', case coalesce(max(case when lower_quartile<5 or median<20 then 2
  when lower_quartile<10 or median<25 then 1 else 0 end),0) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end
  from everyone e left join (select * from quality where n_reads>100) q using (sample_id) group by 1
 union all select sample_id, 'Per sequence quality scores', case when m<20 then 'FAIL' when m<27 then 'WARN' else 'PASS' end from
  (select sample_id, first(mean_q order by n desc, mean_q) m from (select sample_id, mean_q, count(*) n from per_read where length>0 group by 1,2) group by 1)
 union all select sample_id, 'Per base sequence content', case when g>20 then 'FAIL' when g>10 then 'WARN' else 'PASS' end from
  (select sample_id, max(greatest(abs(pct_a-pct_t),abs(pct_g-pct_c))) g from content group by 1)
 union all select sample_id, 'Per sequence GC content', case when g>30 then 'FAIL' when g>15 then 'WARN' else 'PASS' end from
  (select sample_id, 100.0*sum(abs(n_reads-expected))/cast(sum(n_reads) as double) g from gc_table group by 1)
 union all select sample_id, 'Per base N content', case when g>20 then 'FAIL' when g>5 then 'WARN' else 'PASS' end from
  (select sample_id, max(pct_n) g from content group by 1)
 union all select sample_id, 'Sequence Length Distribution', case when min(length)=0 then 'FAIL' when min(length)<>max(length) then 'WARN' else 'PASS' end
  from per_read group by 1
 union all select sample_id, 'Sequence Duplication Levels', case when g>50 then 'FAIL' when g>20 then 'WARN' else 'PASS' end from
  (select sample_id, round(100.0*cast(sum(copies)-count(*) as double)/cast(sum(copies) as double),4) g from seq_counts group by 1)
 union all select sample_id, 'Overrepresented sequences', case when g>1 then 'FAIL' when g>0.1 then 'WARN' else 'PASS' end from
  (select sample_id, 100.0*max(copies)/cast(sum(copies) as double) g from seq_counts group by 1)
 union all select e.sample_id, 'Adapter Content', case when coalesce(g,0)>10 then 'FAIL' when coalesce(g,0)>5 then 'WARN' else 'PASS' end
  from everyone e left join (select sample_id, max(cum_percent) g from adapters group by 1) a using (sample_id))"""

VERDICT = """select sample_id, fails, warns, case when fails>=2 then 'fail' when fails>0 or warns>=3 then 'trim_required' else 'pass' end verdict,
 round(least(0.95e0,0.55e0+least(0.4e0,0.1e0*fails+0.03e0*warns)),3) confidence,
 concat(fails,' failures, ',warns,' warnings in FastQC modules.') quality_summary,
 concat('judged by module flags alone: ',fails,' failed, ',warns,' raised a warning') reasoning"""


def _stored_reads(v) -> DataFrame:
    """What the modules read, stored: several scans follow, and none takes the documents apart again."""
    return materialize(v("reads").select("sample_id", "seq", "quals"))


@query("qc_flags", "reads", f"with {FLAGS} select * from flags")
def _(v):
    return qc.qc_flags(_stored_reads(v), adapters=TEST_ADAPTERS)


@query("qc_sample_verdict", "reads", f"""with {FLAGS}, f as (select sample_id, cast(count(*) filter (status='FAIL') as int) fails,
 cast(count(*) filter (status='WARN') as int) warns from flags group by 1) {VERDICT} from f""")
def sample_verdict(v):
    """Verdict per sample straight from the reads."""
    return decide.qc_verdict(qc.qc_flags(_stored_reads(v), adapters=TEST_ADAPTERS))


@query("qc_verdict", "module_flags", f"with {FLAG_COUNTS} {VERDICT} from f")
def _(v):
    return decide.qc_verdict(v("module_flags"))


PARAM_CASE = """case when fails>=2 then 5 when warns>={w} then 4 else 3 end leading_q,
 case when fails>=2 then 5 when warns>={w} then 4 else 3 end trailing_q,
 case when fails>=2 then '4:22' when warns>={w} then '4:21' else '4:20' end sliding,
 case when fails>=2 then 40 when warns>={w} then 38 else 36 end min_len"""


@query("trim_decision", "module_flags", f"""with {FLAG_COUNTS}, e as (select distinct concat('U',user_id+1) sample_id from events),
 j as (select e.sample_id, fails, warns from e left join f using (sample_id))
 select sample_id, coalesce(fails>0 or warns>=3,false) as "trim", {PARAM_CASE.format(w=4)},
 case when fails is null then 0.45e0 else round(least(0.95e0,0.55e0+least(0.4e0,0.1e0*fails+0.03e0*warns)),2) end confidence,
 'heuristic' source from j""")
def _(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    samples = events.select(F.concat(F.lit("U"), F.col("user_id") + 1).alias("sample_id"))
    return decide.trim_decision(v("module_flags"), samples)


@query("trim_decision_tool_policy", "module_flags", f"""with {FLAG_COUNTS}, u as (select concat('U',user_id) sample_id, cast(max(value) as int)%9 q
 from events where event_type='signup' group by 1),
 h as (select sample_id, {PARAM_CASE.format(w=3)}, least(0.95e0,0.55e0+0.08e0*fails+0.03e0*warns) confidence from f)
 select h.sample_id, case when q is not null then q else leading_q end leading_q, case when q is not null then 3 else trailing_q end trailing_q,
 case when q is not null then '4:20' else sliding end sliding, case when q is not null then 36 else min_len end min_len,
 round(case when q is not null then 1.0 else confidence end,9) confidence, case when q is not null then 'user-supplied' else 'heuristic' end source
 from h left join u using (sample_id)""".replace("cast(max(value) as int)", "cast(floor(max(value)) as int)"))
def _(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").filter("event_type = 'signup'")
    none = F.lit(None)
    user = events.groupBy(F.concat(F.lit("U"), "user_id").alias("sample_id")).agg(
        (F.floor(F.max("value")).cast("int") % 9).alias("leading_q")
    )
    user = user.select(
        "sample_id", "leading_q", none.cast("int").alias("trailing_q"), none.cast("string").alias("sliding"),
        none.cast("int").alias("min_len"),
    )
    out = decide.trim_decision(v("module_flags"), policy="tool", user_params=user)
    return out.withColumn("confidence", F.round("confidence", 9))


@query("normalize_trim_params", "trim_requests", """with a as (select request_id, try_cast(coalesce(leading_q,'3') as int) l,
 try_cast(coalesce(trailing_q,'3') as int) t, try_cast(coalesce(min_len,'36') as int) m, coalesce(sliding,'4:20') s from trim_requests),
 b as (select *, l is null or t is null or m is null bad from a)
 select request_id, case when bad then 3 else greatest(0,least(40,l)) end leading_q, case when bad then 3 else greatest(0,least(40,t)) end trailing_q,
 case when not bad and regexp_matches(s,'^[0-9]+:[0-9]+$') then s else '4:20' end sliding,
 case when bad then 36 else greatest(36,least(200,m)) end min_len from b""")
def _(v):
    return decide.normalize_trim_params(v("trim_requests"))


@query("merge_external_verdicts", "verdict_json", """with h as (select doc_id, least(2,count(*) filter (toxic=1)) fails, 0 warns
 from documents left join labels using (doc_id) group by 1),
 p as (select doc_id, nullif(regexp_extract(raw,'\\{[\\s\\S]*\\}'),'') j from verdict_json),
 k as (select doc_id, case when json_valid(j) then j end j from p),
 w as (select doc_id, j, translate(lower(trim(j->>'verdict')),'- ','__') w, try_cast(j->>'confidence' as double) c from k),
 e as (select doc_id, case when c is null or (j->>'reasoning') is null or (j->>'quality_summary') is null then null when w in ('fail','failed','unusable') then 'fail'
  when contains(w,'trim') then 'trim_required' when w in ('pass','passed','good','ok','okay','accept','accepted') then 'pass' end ev, c, j from w)
 select h.doc_id, coalesce(ev, case when fails>=2 then 'fail' when fails>0 then 'trim_required' else 'pass' end) verdict,
 case when ev is not null then round(greatest(0.0,least(1.0,c)),3) else round(0.55e0+0.1e0*fails,3) end confidence,
 case when ev is not null then j->>'reasoning' else concat('judged by module flags alone: ',fails,' failed, 0 raised a warning') end reasoning,
 case when ev is not null then j->>'quality_summary' else concat(fails,' failures, 0 warnings in FastQC modules.') end quality_summary,
 case when ev is not null then 'external' else 'heuristic' end source from h left join e using (doc_id)""")
def _(v):
    read = v.spark.read.parquet
    docs, labels = read(f"{v.sf_dir}/documents.parquet").select("doc_id"), read(f"{v.sf_dir}/labels.parquet")
    flags = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"), F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("status")
    )
    heuristic = decide.qc_verdict(flags).withColumnRenamed("sample_id", "doc_id")
    return decide.merge_external_verdicts(heuristic, v("verdict_json"), key="doc_id")


@query("qc_summary", "reads alignments", f"""with {PER_READ}, {DUP}, {FLAGS.replace(PER_READ + ',', '').replace(DUP + ',', '')},
 s as (select sample_id, count(*) n_reads, cast(max(length) as int) read_length, round(100.0*cast(sum(gc) as double)/sum(called),4) pct_gc from per_read group by 1),
 c as (select sample_id, count(*) filter (status='PASS') n_pass, count(*) filter (status='WARN') n_warn, count(*) filter (status='FAIL') n_fail,
  max(case when module='Per base sequence quality' then status end) per_base_sequence_quality from flags group by 1),
 d as (select sample_id, round(100.0*cast(sum(copies)-count(*) as double)/cast(sum(copies) as double),4) pct_duplicated from seq_counts group by 1),
 m as (select sample_id, round(100.0*count(*) filter (flag&4=0)/count(*),2) mapping_rate from alignments where flag&2304=0 group by 1)
 select sample_id, n_reads, read_length, pct_gc, n_pass, n_warn, n_fail, per_base_sequence_quality, pct_duplicated, mapping_rate
 from s full join c using (sample_id) full join d using (sample_id) full join m using (sample_id)""")
def _(v):
    from seqframe.operators.alignments import mapping_rate

    reads = _stored_reads(v)
    return qc.qc_summary(
        qc.basic_stats(qc.read_profile(reads, quality=False)).select("sample_id", "n_reads", "read_length", "pct_gc"),
        qc.qc_flags(reads, adapters=TEST_ADAPTERS),
        duplication=qc.duplication_rate(qc.sequence_counts(reads)).select("sample_id", "pct_duplicated"),
        mapping=mapping_rate(v("alignments")),
        modules=(qc.BASE_QUALITY,),
    )
