"""Checks of differential expression and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.functions.ordering import bh_adjust
from seqframe.functions.scratch import materialize
from seqframe.operators import de, enrich
from seqframe.plans.registry import query

FACTORS = """logs as (select gene_id, avg(ln(cnt)) m from counts where cnt>0 group by 1 having count(*)=(select count(distinct sample_id) from counts)),
 factors as (select sample_id, exp(median(ln(cnt)-m)) size_factor from counts join logs using (gene_id) group by 1),
 norm as (select gene_id, sample_id, cnt, cnt/size_factor x from counts join factors using (sample_id))"""
DISP = f"""{FACTORS}, mom as (select gene_id, avg(x) mean, var_samp(x) v from norm group by 1 having avg(x)>0),
 genes as (select gene_id, mean, greatest((v-(select avg(1/size_factor) from factors)*mean)/(mean*mean),1e-8) dg from mom),
 trend as (select greatest(coalesce(regr_intercept(dg,1/mean),0),1e-4) a0, greatest(coalesce(regr_slope(dg,1/mean),0),0) a1 from genes where dg>1e-7)"""
VST = f"""{DISP}, vst as (select gene_id, sample_id, log2((1+a1+2*a0*x+2*sqrt(a0*x*(1+a1+a0*x)))/(4*a0)) vst from norm, trend)"""
# The first two axes by power iteration, the second after the first is taken out; the larger end of an axis is positive.
PCA = """tops as (select gene_id from vst group by 1 order by var_samp(vst) desc nulls last, gene_id limit 500),
 cen as (select sample_id, gene_id, vst-avg(vst) over (partition by gene_id) c from vst join tops using (gene_id)),
 ord as (select sample_id, row_number() over (order by sample_id) i from (select distinct sample_id from cen)),
 cell as (select i, gene_id, c from cen join ord using (sample_id)),
 gram as (select a.i, b.i j, sum(a.c*b.c) x from cell a join cell b using (gene_id) group by 1,2),
 mat as (select list(r order by i) m, list_sum(list(r[i] order by i)) whole from (select i, list(x order by j) r from gram group by 1)),
 pow1 as (select 0 k, list_transform(range(1,len(m)+1), lambda i: sin(i)) v from mat
  union all select k+1, list_transform(list_transform(m, lambda r: list_dot_product(r,v)), lambda y: y/sqrt(list_sum(list_transform(m, lambda r: pow(list_dot_product(r,v),2))))) from pow1, mat where k<2000),
 ax1 as (select v, sqrt(list_sum(list_transform(m, lambda r: pow(list_dot_product(r,v),2)))) l from pow1, mat where k=2000),
 mat2 as (select list_transform(range(1,len(m)+1), lambda i: list_transform(range(1,len(m)+1), lambda j: m[i][j]-l*v[i]*v[j])) m from mat, ax1),
 pow2 as (select 0 k, list_transform(range(1,len(m)+1), lambda i: cos(i)) v from mat2
  union all select k+1, list_transform(list_transform(m, lambda r: list_dot_product(r,v)), lambda y: y/sqrt(list_sum(list_transform(m, lambda r: pow(list_dot_product(r,v),2))))) from pow2, mat2 where k<2000),
 ax2 as (select v, sqrt(list_sum(list_transform(m, lambda r: pow(list_dot_product(r,v),2)))) l from pow2, mat2 where k=2000),
 axes as (select cast(1 as int) pc, v, l from ax1 union all select 2, v, l from ax2),
 pca as (select sample_id, pc, v[i]*sqrt(l)*case when list_max(v)>=-list_min(v) then 1 else -1 end score, round(100*l/whole) percent_var from axes, mat, ord)"""


def _det(a, b, c, d, e, f, g, h, i):
    return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"


def _equations(w, z):
    """Weighted normal equations of the design (1, batch, condition) over the samples of a gene."""
    total = lambda e: f"list_sum(list_transform(range(1,len(y)+1), lambda s: {e}))"
    terms = {"a11": w, "a12": f"{w}*xb[s]", "a13": f"{w}*xc[s]", "a22": f"{w}*xb[s]*xb[s]", "a23": f"{w}*xb[s]*xc[s]", "a33": f"{w}*xc[s]*xc[s]"}
    terms |= {"c1": f"{w}*{z}", "c2": f"{w}*{z}*xb[s]", "c3": f"{w}*{z}*xc[s]"}
    return ", ".join(f"{total(e)}{'+1e-6' if n in ('a11', 'a22', 'a33') else ''} {n}" for n, e in terms.items())


_DET = _det("a11", "a12", "a13", "a12", "a22", "a23", "a13", "a23", "a33")
_SOLVED = [
    _det("c1", "a12", "a13", "c2", "a22", "a23", "c3", "a23", "a33"),
    _det("a11", "c1", "a13", "a12", "c2", "a23", "a13", "c3", "a33"),
    _det("a11", "a12", "c1", "a12", "a22", "c2", "a13", "a23", "c3"),
]
_MU = "list_transform(range(1,len(y)+1), lambda s: exp(greatest(-30, least(30, b1+b2*xb[s]+b3*xc[s]+off[s])))) m"
_BETA = ", ".join(f"{b}/{_DET} b{i + 1}" for i, b in enumerate(_SOLVED))
_CLIPPED = ", ".join(f"greatest(-30, least(30, {b}/{_DET}))" for b in _SOLVED)
_TRIGAMMA = repr(de.trigamma(1.5))  # six samples less intercept, batch and condition

# Fifty rounds of reweighted least squares for each gene; the normal tail is a series.
DESIGN = f"""{FACTORS}, seen as (select gene_id, list(x order by sample_id) y, list(case when batch='b2' then 1e0 else 0e0 end order by sample_id) xb,
  list(case when condition='treated' then 1e0 else 0e0 end order by sample_id) xc from norm join samples using (sample_id) group by 1),
 plain as (select gene_id, y, xb, xc, {_BETA} from (select *, {_equations("1.0", "y[s]").replace("+1e-6", "")} from seen)),
 mom as (select gene_id, list_avg(y) mean, list_sum(list_transform(range(1,len(y)+1), lambda s: pow(y[s]-b1-b2*xb[s]-b3*xc[s],2)))/(len(y)-3) v from plain where list_avg(y)>0),
 genes as (select gene_id, mean, greatest((v-(select avg(1/size_factor) from factors)*mean)/(mean*mean),1e-8) dg from mom),
 trend as (select greatest(coalesce(regr_intercept(dg,1/mean),0),1e-4) a0, greatest(coalesce(regr_slope(dg,1/mean),0),0) a1 from genes where dg>1e-7)"""
WALD = f"""fd as (select gene_id, mean, dg, a1/mean+a0 dt from genes, trend),
 pr as (select greatest(coalesce(var_samp(ln(dg)-ln(dt)),0)-{_TRIGAMMA}, 0.25) prior from fd where dg>1e-7),
 dis as (select gene_id, mean, exp(prior/(prior+{_TRIGAMMA})*ln(dg)+(1-prior/(prior+{_TRIGAMMA}))*ln(dt)) a from fd, pr),
 grid as (select d.gene_id, s.sample_id, coalesce(c.cnt,0)*1e0 y, ln(f.size_factor) o, case when s.batch='b2' then 1e0 else 0e0 end b, case when s.condition='treated' then 1e0 else 0e0 end t
  from dis d cross join samples s join factors f using (sample_id) left join counts c on c.gene_id=d.gene_id and c.sample_id=s.sample_id),
 obs as (select gene_id, any_value(mean) mean, any_value(a) a, list(y order by sample_id) y, list(o order by sample_id) off, list(b order by sample_id) xb, list(t order by sample_id) xc
  from grid join dis using (gene_id) group by 1),
 begun as (select *, {_equations("1.0", "ln(y[s]/exp(off[s])+0.1)")} from obs),
 irls as (select gene_id, 0 k, {_BETA} from begun union all select gene_id, k+1, {_CLIPPED} from (
  select gene_id, k, {_equations("(m[s]/(1+a*m[s]))", "(b1+b2*xb[s]+b3*xc[s]+(y[s]-m[s])/m[s])")} from (select *, {_MU} from irls join obs using (gene_id) where k<50))),
 fitted as (select gene_id gene, mean baseMean, b3/ln(2) log2FoldChange, sqrt((a11*a22-a12*a12)/{_DET})/ln(2) lfcSE from (
  select *, {_equations("(m[s]/(1+a*m[s]))", "0.0")} from (select *, {_MU} from irls join obs using (gene_id) where k=50))),
 st as (select *, log2FoldChange/lfcSE stat, abs(log2FoldChange/lfcSE)/sqrt(2) x from fitted),
 wald as (select *, case when x>5.5 then 0 when x=0 then 1 else 1-2/sqrt(pi())*exp(-x*x)*list_sum(list_transform(range(0,150), lambda n: exp(2*n*ln(2)+(2*n+1)*ln(x)+lgamma(n+1)-lgamma(2*n+2)))) end pvalue from st),
 rw as (select *, row_number() over (order by pvalue) rk, count(*) over () n from wald),
 tested as (select *, least(1.0, min(pvalue*n/rk) over (order by pvalue desc, rk desc rows between unbounded preceding and current row)) padj from rw)"""
BH = """ranked as (select *, row_number() over (order by pvalue) rk, count(*) over () n from de_raw where pvalue is not null),
 adj as (select gene, least(1.0, min(pvalue*n/rk) over (order by pvalue desc, rk desc rows between unbounded preceding and current row)) padj from ranked),
 res as (select d.*, adj.padj from de_raw d left join adj using (gene))"""
SIG = f"{BH}, sig as (select distinct gene from res where padj<0.05 and abs(log2FoldChange)>1)"
CLOSURE = """up as (select child term, parent ancestor from term_edges union select up.term, e.parent from up join term_edges e on up.ancestor=e.child),
 closure as (select * from up union select child, child from term_edges union select parent, parent from term_edges)"""
ORA = f"""{CLOSURE}, {SIG}, gt as (select distinct gene, ancestor term from gene_terms join closure using (term)),
 t as (select term, count(*) m, count(sig.gene) k from gt left join sig using (gene) group by 1),
 u as (select count(distinct gt.gene) nn, count(distinct sig.gene) n from gt left join sig using (gene)),
 tested as (select term, k, n, m set_size, nn universe, least(1.0,list_sum(list_transform(range(k, least(n,m)+1), lambda i:
  exp(lgamma(m+1)-lgamma(i+1)-lgamma(m-i+1)+lgamma(nn-m+1)-lgamma(n-i+1)-lgamma(nn-m-n+i+1)-lgamma(nn+1)+lgamma(n+1)+lgamma(nn-n+1))))) pvalue
  from t, u where k>0 and m between 10 and 500),
 tr as (select *, row_number() over (order by pvalue) rk, count(*) over () cn, least(1.0, count(*) filter (pvalue>0.5) over ()/(count(*) over ()*0.5e0)) pi0 from tested),
 ta as (select *, least(1.0, min(pvalue*cn/rk) over (order by pvalue desc, rk desc rows between unbounded preceding and current row)) p_adjust from tr),
 go as (select *, p_adjust*case when pi0>0 then pi0 else 1.0 end qvalue from ta)"""


def _normalized(v):
    counts = v("counts")
    factors = materialize(de.size_factors(counts))
    return de.normalize_counts(counts, factors), factors


def _vst(v):
    normalized, factors = _normalized(v)
    return materialize(de.variance_stabilize(normalized, de.dispersion_trend(de.gene_dispersions(normalized, factors))))


def _results(v):
    return bh_adjust(v("de_raw"))


def _r(*names, digits=6):
    return {n: F.round(n, digits) for n in names}


@query("align_design", "counts samples", """select gene_id, c.sample_id, cnt, condition, batch from counts c join samples s on c.sample_id=s.sample_id where c.sample_id<>'S2'""")
def _(v):
    cnt, sheet = de.align_design(v("counts"), v("samples").filter("sample_id <> 'S2'"))
    return cnt.join(sheet, "sample_id").select("gene_id", "sample_id", "cnt", "condition", "batch")


@query("contrast_levels", "samples", "select max(condition) test_level, min(condition) base_level from samples")
def _(v):
    return de.contrast_levels(v("samples"))


@query("size_factors", "counts", f"with {FACTORS} select sample_id, round(size_factor,9) size_factor from factors")
def _(v):
    return de.size_factors(v("counts")).withColumns(_r("size_factor", digits=9))


@query("normalize_counts", "counts", f"with {FACTORS} select gene_id, sample_id, round(x,6) norm from norm")
def _(v):
    return _normalized(v)[0].select("gene_id", "sample_id", F.round("norm", 6).alias("norm"))


@query("base_mean", "counts", f"with {FACTORS} select gene_id, round(avg(x),6) baseMean from norm group by 1")
def _(v):
    return de.base_mean(_normalized(v)[0]).withColumns(_r("baseMean"))


@query("dispersions", "counts samples", f"""with {DESIGN}, f as (select gene_id, mean, dg, a1/mean+a0 dt from genes, trend),
 s as (select greatest(coalesce(var_samp(ln(dg)-ln(dt)),0)-{_TRIGAMMA}, 0.25) prior from f where dg>1e-7)
 select gene_id, round(mean,6) mean, round(dg,6) disp_gene, round(dt,6) disp_trend,
 round(exp(prior/(prior+{_TRIGAMMA})*ln(dg)+(1-prior/(prior+{_TRIGAMMA}))*ln(dt)),6) dispersion from f, s""")
def _(v):
    return de.dispersions(*_normalized(v), v("samples")).withColumns(_r("mean", "disp_gene", "disp_trend", "dispersion"))


@query("variance_stabilize", "counts", f"with {VST} select gene_id, sample_id, round(vst,6) vst from vst")
def _(v):
    return _vst(v).select("gene_id", "sample_id", F.round("vst", 6).alias("vst"))


@query("nb_wald_test", "counts samples", f"""with recursive {DESIGN}, {WALD} select gene, round(baseMean,6) baseMean, round(log2FoldChange,5) log2FoldChange, round(lfcSE,5) lfcSE,
 round(stat,5) stat, round(pvalue,6) pvalue, round(padj,6) padj from tested""")
def _(v):
    out = de.differential_expression(v("counts"), v("samples"))
    return out.withColumns(_r("baseMean", "pvalue", "padj") | _r("log2FoldChange", "lfcSE", "stat", digits=5))


@query("sample_pca", "counts", f"with recursive {VST}, {PCA} select sample_id, pc, round(score,6) score, percent_var from pca")
def _(v):
    return de.sample_pca(_vst(v)).withColumns(_r("score"))


@query("bh_adjust", "de_raw", f"with {BH} select gene, round(pvalue,9) pvalue, round(padj,9) padj from res")
def _(v):
    return _results(v).select("gene", F.round("pvalue", 9).alias("pvalue"), F.round("padj", 9).alias("padj"))


@query("bh_adjust_by_group", "", """with d as (select l_returnflag grp, l_suppkey item, avg(l_discount)*5 p from lineitem group by 1,2),
 r as (select *, row_number() over (partition by grp order by p) rk, count(*) over (partition by grp) n from d)
 select grp, item, round(least(1.0, min(p*n/rk) over (partition by grp order by p desc, rk desc rows between unbounded preceding and current row)),9) padj from r""")
def _(v):
    rows = v.spark.read.parquet(f"{v.sf_dir}/lineitem.parquet")
    p = rows.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("item")).agg((F.avg("l_discount") * 5).alias("p"))
    return bh_adjust(p, "p", by=["grp"]).select("grp", "item", F.round("padj", 9).alias("padj"))


@query("de_results", "de_raw", f"""with {BH} select gene, baseMean, log2FoldChange, cast(null as double) lfcSE, cast(null as double) stat, pvalue, round(padj,9) padj from res""")
def _(v):
    return de.de_results(v("de_raw")).withColumns(_r("padj", digits=9))


@query("de_significant", "de_raw", f"""with {BH} select 'summary' as set_name, gene, round(padj,9) padj from res where padj<0.05 union all select 'go', gene, round(padj,9) from res where padj<0.05 and abs(log2FoldChange)>1""")
def _(v):
    res = _results(v)
    parts = [de.de_significant(res).withColumn("set_name", F.lit("summary")), de.de_significant(res, lfc=1.0).withColumn("set_name", F.lit("go"))]
    return parts[0].unionByName(parts[1]).select("set_name", "gene", F.round("padj", 9).alias("padj"))


@query("de_summary", "de_raw", f"""with {BH} select count(*) n_genes_tested, count(*) filter (padj<0.05) n_sig, count(*) filter (padj<0.05 and log2FoldChange>0) n_up,
 count(*) filter (padj<0.05 and log2FoldChange<0) n_down from res""")
def _(v):
    return de.de_summary(_results(v))


@query("pc1_warning", "de_raw counts", f"""with recursive {BH}, {VST}, {PCA} select count(*) n_genes_tested, count(*) filter (padj<0.05) n_sig, count(*) filter (padj<0.05 and log2FoldChange>0) n_up,
 count(*) filter (padj<0.05 and log2FoldChange<0) n_down, (select max(percent_var) from pca where pc=1) pc1_variance,
 case when (select max(percent_var) from pca where pc=1)<50 then ['PC1 variance below 50%'] else cast([] as varchar[]) end warnings from res""")
def _(v):
    return de.de_summary(_results(v), de.sample_pca(_vst(v)))


@query("ma_table", "de_raw", f"with {BH} select gene, round(log10(baseMean),6) log10_base_mean, log2FoldChange, coalesce(padj<0.05,false) sig from res")
def _(v):
    return de.ma_table(_results(v)).withColumns(_r("log10_base_mean"))


@query("volcano_table", "de_raw", f"""with {BH}, top as (select gene from res where padj is not null order by padj, gene limit 10)
 select gene, log2FoldChange, round(-log10(padj),6) neg_log10_padj, case when padj<0.05 and abs(log2FoldChange)>1 then 'p_and_log2FC' when padj<0.05 then 'p'
 when abs(log2FoldChange)>1 then 'log2FC' else 'NS' end as "class", case when gene in (select gene from top) then gene end as label from res""")
def _(v):
    return de.volcano_table(_results(v)).withColumns(_r("neg_log10_padj"))


@query("top_variable_genes", "counts", f"with {VST} select gene_id, round(var_samp(vst),6) variance from vst group by 1 order by var_samp(vst) desc, gene_id limit 50")
def _(v):
    return de.top_variable_genes(_vst(v)).withColumns(_r("variance"))


@query("row_zscore", "counts", f"""with {VST} select gene_id, sample_id, round((vst-avg(vst) over (partition by gene_id))/nullif(stddev_samp(vst) over (partition by gene_id),0),6) zscore from vst""")
def _(v):
    return de.row_zscore(_vst(v)).select("gene_id", "sample_id", F.round("zscore", 6).alias("zscore"))


@query("significant_genes", "de_raw", f"with {SIG} select gene from sig")
def _(v):
    return enrich.significant_genes(_results(v))


@query("map_gene_ids", "de_raw idmap", f"with {SIG} select distinct symbol, entrez from idmap join sig on gene=symbol")
def _(v):
    return enrich.map_gene_ids(enrich.significant_genes(_results(v)), v("idmap"))


@query("term_closure", "term_edges", f"with recursive {CLOSURE} select distinct term, ancestor from closure")
def _(v):
    return enrich.term_closure(v("term_edges"))


def _gene_terms(v):
    return enrich.propagate_terms(v("gene_terms"), enrich.term_closure(v("term_edges")))


@query("propagate_terms", "gene_terms term_edges", f"with recursive {CLOSURE} select distinct gene, ancestor term from gene_terms join closure using (term)")
def _(v):
    return _gene_terms(v)


@query("over_representation", "de_raw gene_terms term_edges", f"with recursive {ORA} select term, k, n, set_size, universe, round(pvalue,9) pvalue from tested")
def _(v):
    return enrich.over_representation(enrich.significant_genes(_results(v)), _gene_terms(v)).withColumns(_r("pvalue", digits=9))


@query("adjust_terms", "de_raw gene_terms term_edges", f"with recursive {ORA} select term, round(p_adjust,8) p_adjust, round(qvalue,8) qvalue from go")
def _(v):
    tested = enrich.over_representation(enrich.significant_genes(_results(v)), _gene_terms(v))
    return enrich.adjust_terms(tested).select("term", F.round("p_adjust", 8).alias("p_adjust"), F.round("qvalue", 8).alias("qvalue"))


@query("readable_members", "de_raw gene_terms", f"""with {SIG} select term, string_agg(gene,'/' order by gene) geneID, count(*) as "Count" from (select distinct term, gene from gene_terms join sig using (gene)) group by 1""")
def _(v):
    return enrich.readable_members(enrich.significant_genes(_results(v)), v("gene_terms"))


GO = f"""{ORA}, members as (select term, string_agg(gene,'/' order by gene) geneID, count(*) c from gt join sig using (gene) group by 1),
 enriched as (select go.term as "ID", go.term as "Description", concat(k,'/',n) "GeneRatio", concat(set_size,'/',universe) "BgRatio", round(pvalue,8) pvalue, round(p_adjust,8) p_adjust, round(qvalue,8) qvalue, geneID, c as "Count"
 from go join members using (term) where pvalue<=1 and p_adjust<=1 and qvalue<=1)"""


def _go(v):
    genes = enrich.significant_genes(_results(v))
    # open cut-offs: the test tables hold no strong signal
    return enrich.go_enrichment(genes, _gene_terms(v), p_cut=1.0, q_cut=1.0), genes


@query("go_enrichment", "de_raw gene_terms term_edges", f"with recursive {GO} select * from enriched")
def _(v):
    return _go(v)[0].withColumns(_r("pvalue", "p_adjust", "qvalue", digits=8))


@query("go_evidence", "de_raw gene_terms term_edges", f"""with recursive {GO} select 'treated' treatment, 'control' control,
 coalesce((select string_agg("ID",',' order by p_adjust, pvalue, "ID") from (select * from enriched order by p_adjust, pvalue, "ID" limit 10)),'') top_go_terms,
 coalesce((select string_agg(gene,',' order by gene) from (select gene from sig order by gene limit 25)),'') sig_genes""")
def _(v):
    go, genes = _go(v)
    rounded = go.withColumns(_r("pvalue", "p_adjust", digits=8))
    out = enrich.evidence(rounded, genes)
    return out.withColumns({c: F.array_join(c, ",") for c in ("top_go_terms", "sig_genes")})


@query("go_summary", "de_raw gene_terms term_edges", f"""with recursive {GO} select (select count(*) from res where padj<0.05 and abs(log2FoldChange)>1) n_sig, (select count(*) from enriched) n_go""")
def _(v):
    return enrich.go_summary(_results(v), _go(v)[0])


@query("go_no_genes", "", """select 'x' "ID", 'x' "Description", 'x' "GeneRatio", 'x' "BgRatio", 1e0 pvalue, 1e0 p_adjust, 1e0 qvalue, 'x' geneID, cast(1 as bigint) "Count" where false""")
def _(v):
    none = enrich.significant_genes(_results(v).withColumn("padj", F.lit(None).cast("double")))
    return enrich.go_enrichment(none, _gene_terms(v))
