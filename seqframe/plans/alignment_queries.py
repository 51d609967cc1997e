"""Checks of the alignment, counting and coverage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.operators import alignments as al
from seqframe.operators import counts as ct
from seqframe.operators import coverage as cv
from seqframe.operators.decide import alignment_gate, coverage_gate
from seqframe.operators.intervals import overlap_join
from seqframe.plans.registry import query

OPS = r"""ops as (select * exclude (i), cast(i as int) i, cast(regexp_extract_all(cigar,'(\d+)([MIDNSHP=X])',1)[i] as bigint) oplen,
 regexp_extract_all(cigar,'(\d+)([MIDNSHP=X])',2)[i] op
 from (select *, unnest(range(1,len(regexp_extract_all(cigar,'\d+[A-Z=]'))+1)) i from alignments where flag&4=0)),
 placed as (select *, pos + cast(coalesce(sum(case when op in ('M','D','N','=','X') then oplen else 0 end)
 over (partition by aln_id order by i rows between unbounded preceding and 1 preceding),0) as bigint) s,
 sum(case when op='N' then 1 else 0 end) over (partition by aln_id order by i) part from ops),
 blocks as (select aln_id, sample_id, chrom, nh, min(s) start_pos, max(s+oplen-1) end_pos from placed where op in ('M','=','X','D')
 group by aln_id, sample_id, chrom, nh, part)"""
ASSIGN = f"""{OPS}, touched as (select b.aln_id, b.sample_id, min(gene_id) lo, max(gene_id) hi from blocks b
 left join exons e on b.chrom=e.chrom and b.start_pos<=e.end_pos and e.start_pos<=b.end_pos where nh<=1 group by 1,2),
 assigned as (select sample_id, aln_id, case when lo is null then 'Unassigned_NoFeatures' when lo<>hi then 'Unassigned_Ambiguity' else 'Assigned' end status,
 case when lo=hi then lo end gene_id from touched union all select sample_id, aln_id,
 case when flag&4<>0 then 'Unassigned_Unmapped' else 'Unassigned_MultiMapping' end, null from alignments where flag&4<>0 or nh>1)"""
DEPTH = f"""{OPS}, edges as (select sample_id, chrom, p, sum(d) d from (select sample_id, chrom, s p, 1 d from placed
 where op in ('M','=','X') and flag&1796=0 union all select sample_id, chrom, s+oplen, -1 from placed where op in ('M','=','X') and flag&1796=0)
 group by 1,2,3 having sum(d)<>0),
 runs as (select * from (select sample_id, chrom, p start_pos, lead(p) over w - 1 end_pos, cast(sum(d) over w as bigint) depth from edges
 window w as (partition by sample_id, chrom order by p)) where depth>0)"""
REGION = f"""{DEPTH}, cov as (select s.sample_id, p.name gene, concat(p.chrom,':',p.start0+1,'-',p.end0) region,
 coalesce(round(cast(sum((least(end_pos,end0)-greatest(start_pos,start0+1)+1)*depth) as double)/sum(least(end_pos,end0)-greatest(start_pos,start0+1)+1),4),0.0) mean_depth
 from panel p cross join (select distinct sample_id from alignments) s left join runs r on r.sample_id=s.sample_id and r.chrom=p.chrom and r.start_pos<=p.end0 and r.end_pos>=p.start0+1
 group by s.sample_id, p.name, p.chrom, p.start0, p.end0)"""


def _assigned(v):
    return ct.assign_reads(v("alignments"), v("exons"))


def _coverage(v):
    rows = v("alignments")
    return cv.region_mean_depth(cv.depth(rows), v("panel"), rows)


@query("mapping_rate", "alignments", """select sample_id, round(100.0*count(*) filter (flag&4=0)/count(*),2) mapping_rate
 from alignments where flag&2304=0 group by 1""")
def _(v):
    return al.mapping_rate(v("alignments"))


@query("alignment_gate", "alignments", """with r as (select sample_id, 100.0*count(*) filter (flag&4=0)/count(*) rate from alignments where flag&2304=0 group by 1)
 select sample_id, round(rate,2) mapping_rate, case when rate<84.0 then 'fail' else 'pass' end status,
 case when rate<84.0 then case when sample_id in ('S3','S6') then 'abort' else 're_trim' end end as "action" from r""")
def _(v):
    advice = v("samples").filter("replicate_group <> '3'").select("sample_id", F.lit("re_trim").alias("action"))
    return alignment_gate(al.mapping_rate(v("alignments"), digits=None), advice, minimum=84.0)


@query("flagstat", "alignments", """select sample_id, case when flag&512=0 then 'passed' else 'failed' end qc, count(*) total,
 count(*) filter (flag&2304=0) n_primary, count(*) filter (flag&256<>0) secondary, count(*) filter (flag&2048<>0) supplementary,
 count(*) filter (flag&1024<>0) duplicates, count(*) filter (flag&2304=0 and flag&1024<>0) primary_duplicates,
 count(*) filter (flag&4=0) mapped, count(*) filter (flag&4=0 and flag&2304=0) primary_mapped,
 count(*) filter (flag&2304=0 and flag&1<>0) paired, count(*) filter (flag&2304=0 and flag&65=65) read1, count(*) filter (flag&2304=0 and flag&129=129) read2,
 count(*) filter (flag&2304=0 and flag&3=3 and flag&4=0) properly_paired, count(*) filter (flag&2304=0 and flag&1<>0 and flag&12=0) both_mapped,
 count(*) filter (flag&2304=0 and flag&1<>0 and flag&12=8) singletons,
 count(*) filter (flag&2304=0 and flag&1<>0 and flag&12=0 and rnext<>'=' and rnext<>chrom and rnext<>'*') mate_elsewhere,
 count(*) filter (flag&2304=0 and flag&1<>0 and flag&12=0 and rnext<>'=' and rnext<>chrom and rnext<>'*' and mapq>=5) mate_elsewhere_mapq5
 from alignments group by 1,2""")
def _(v):
    return al.flagstat(v("alignments"))


@query("coordinate_sort", "alignments", """select sample_id, qname, chrom, pos, flag, cast(case when flag&4<>0 then 2147483647 else 6-cast(substr(chrom,4) as int) end as int) contig_idx from alignments""")
def _(v):
    rows = v("alignments")
    # header order given by the test: last chromosome first
    contigs = rows.select("chrom").distinct().withColumn("contig_idx", 6 - F.expr("cast(substr(chrom, 4) as int)"))
    return al.coordinate_sort(rows, contigs).select("sample_id", "qname", "chrom", "pos", "flag", "contig_idx")


@query("view_region", "alignments", r"""select sample_id, qname, chrom, pos, flag, mapq, cigar from alignments where chrom='chr2' and pos<=30000 and flag&16=16
 and flag&256=0 and mapq>=10 and pos+list_sum(list_transform(regexp_extract_all(cigar,'(\d+)[MDN=X]',1), lambda x: cast(x as bigint)))-1>=5000""")
def _(v):
    out = al.view(v("alignments"), "chr2:5,000-30,000", require=16, exclude=256, min_mapq=10)
    return out.select("sample_id", "qname", "chrom", "pos", "flag", "mapq", "cigar")


@query("alignment_blocks", "alignments", f"with {OPS} select sample_id, chrom, start_pos, end_pos, count(*) n from blocks group by all")
def _(v):
    blocks = al.alignment_blocks(v("alignments"))
    return blocks.groupBy("sample_id", "chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n"))


FRAGMENTS = r"""u as (select *, pos + list_sum(list_transform(regexp_extract_all(cigar,'(\d+)[MDN=X]',1), lambda x: cast(x as bigint))) - 1
 + coalesce(cast(nullif(regexp_extract(cigar,'(\d+)S$',1),'') as bigint),0) e, pos - coalesce(cast(nullif(regexp_extract(cigar,'^(\d+)S',1),'') as bigint),0) b
 from alignments where flag&2308=0),
 f as (select sample_id, library, qname, min((chrom, case when flag&16<>0 then e else b end, flag&16<>0)) e1,
 max((chrom, case when flag&16<>0 then e else b end, flag&16<>0)) e2, sum(qual_sum) score from u group by 1,2,3),
 r as (select sample_id, library, qname, row_number() over (partition by sample_id, library, e1, e2 order by score desc, qname) rn from f),
 marked as (select a.*, case when r.rn>1 then (a.flag & ~1024) | 1024 else a.flag & ~1024 end mflag
 from alignments a left join r on a.flag&2308=0 and a.sample_id=r.sample_id and a.library=r.library and a.qname=r.qname)"""


@query("mark_duplicates", "alignments", f"with {FRAGMENTS} select sample_id, library, qname, chrom, pos, cast(mflag as int) flag, qual_sum from marked")
def _(v):
    out = al.mark_duplicates(v("alignments"), F.col("qual_sum"))
    return out.select("sample_id", "library", "qname", "chrom", "pos", "flag", "qual_sum")


@query("duplication_metrics", "alignments", f"""with recursive {FRAGMENTS}, c as (select sample_id, library, count(*) examined, count(*) filter (mflag&1024<>0) duplicates
 from marked where flag&2308=0 group by 1,2),
 b as (select sample_id, library, examined, duplicates, 0 i, 1.0e0 lo, 1e6 hi, cast(examined as double) n, cast(examined-duplicates as double) c from c
 union all select sample_id, library, examined, duplicates, i+1, case when c/((lo+hi)/2*c)-1+exp(-n/((lo+hi)/2*c))>0 then (lo+hi)/2 else lo end,
 case when c/((lo+hi)/2*c)-1+exp(-n/((lo+hi)/2*c))>0 then hi else (lo+hi)/2 end, n, c from b where i<60)
 select sample_id, library, examined, duplicates, round(100.0*duplicates/examined,4) pct_duplicates,
 case when c>0 and n>c then round(c*(lo+hi)/2/10) end library_size from b where i=60""")
def _(v):
    out = al.duplication_metrics(al.mark_duplicates(v("alignments"), F.col("qual_sum")))
    return out.withColumn("library_size", F.round(F.col("library_size").cast("double") / 10))


@query("overlap_join", "alignments exons", f"""with {OPS} select b.sample_id, b.chrom, e.gene_id, count(*) n_pairs from blocks b join exons e
 on b.chrom=e.chrom and b.start_pos<=e.end_pos and e.start_pos<=b.end_pos group by 1,2,3""")
def _(v):
    pairs = overlap_join(al.alignment_blocks(v("alignments")), v("exons"), bin_size=1024)
    return pairs.groupBy("sample_id", "chrom", "gene_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("assign_reads", "alignments exons", f"with {ASSIGN} select sample_id, status, gene_id, count(*) n from assigned group by 1,2,3")
def _(v):
    return _assigned(v).groupBy("sample_id", "status", "gene_id").agg(F.count(F.lit(1)).alias("n"))


@query("feature_counts", "alignments exons", f"""with {ASSIGN} select g.gene_id, s.sample_id, count(a.gene_id) cnt from (select distinct gene_id from exons) g
 cross join (select distinct sample_id from alignments) s left join assigned a on a.gene_id=g.gene_id and a.sample_id=s.sample_id group by 1,2""")
def feature_counts(v):
    return ct.feature_counts(_assigned(v), v("exons"), v("alignments"))


@query("assignment_summary", "alignments exons", f"""with {ASSIGN} select sample_id, count(*) filter (status='Assigned') assigned, count(*) filter (status='Unassigned_Unmapped') unmapped,
 count(*) filter (status='Unassigned_MultiMapping') multi_mapping, count(*) filter (status='Unassigned_NoFeatures') no_features,
 count(*) filter (status='Unassigned_Ambiguity') ambiguity, count(*) total from assigned group by 1""")
def _(v):
    return ct.assignment_summary(_assigned(v))


@query("matrix_shape", "counts", "select count(distinct gene_id) n_genes, count(distinct sample_id) n_columns from counts")
def _(v):
    return ct.matrix_shape(v("counts"))


@query("merge_counts", "counts", """select gene_id, sample_id, cnt from counts where sample_id in
 (select concat('S',user_id%6+1) from events group by 1 having sum(value)>(select avg(s) from (select sum(value) s from events group by user_id%6)))""")
def _(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    spent = events.groupBy(F.expr("concat('S', user_id % 6 + 1)").alias("sample_id")).agg(F.sum("value").alias("s"))
    level = spent.agg(F.avg("s").alias("level"))
    successful = spent.join(F.broadcast(level), F.col("s") > F.col("level"))  # one-row side
    counts = v("counts")
    low, high = counts.filter("sample_id <= 'S3'"), counts.filter("sample_id > 'S3'")
    return ct.merge_counts([low, high], successful).select("gene_id", "sample_id", "cnt")


@query("depth_runs", "alignments", f"with {DEPTH} select sample_id, chrom, start_pos, end_pos, depth from runs")
def _(v):
    return cv.depth(v("alignments"))


@query("region_mean_depth", "alignments panel", f"with {REGION} select * from cov")
def _(v):
    return _coverage(v)


@query("panel_mean_depth", "alignments panel", f"with {REGION} select sample_id, round(avg(mean_depth),6) mean_depth from cov group by 1")
def _(v):
    return cv.panel_mean_depth(_coverage(v)).withColumn("mean_depth", F.round("mean_depth", 6))


@query("coverage_gate", "alignments panel", f"""with {REGION}, m as (select gene, (cast(sum(cast(round(mean_depth*10000) as bigint)) as bigint)//(10*count(*)))/1000.0e0 d from cov group by 1)
 select gene, round(d,3) mean_depth, 3.0e0 threshold, d>=3 passed, case when d>=3 then 'ok' else 'warn' end status, d<3 halt,
 case when d<3 then 'Coverage below threshold' else '' end halt_reason from m""")
def _(v):
    # the mean over samples in whole thousandths, so that both engines round alike
    total = F.sum(F.round(F.col("mean_depth") * 10000).cast("bigint")).alias("t")
    means = _coverage(v).groupBy("gene").agg(total, F.count(F.lit(1)).alias("n"))
    means = means.select("gene", (F.expr("t div (10 * n)") / 1000.0).alias("mean_depth"))
    return coverage_gate(means, keys=("gene",), threshold=3)
