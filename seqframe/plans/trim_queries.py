"""Checks of the trimming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqframe.functions.quality import encode_phred33
from seqframe.operators import trim
from seqframe.plans.registry import query

PARAMS = """params as (select sample_id, case when n%2=0 then 5 else 3 end leading_q, case when n%2=0 then 6 else 3 end trailing_q,
 case when n%3=0 then '5:22' else '4:20' end sliding, case when n%2=0 then 40 else 36 end min_len
 from (select distinct cast(l_orderkey%6+1 as int) n, concat('S',l_orderkey%6+1) sample_id from lineitem))"""


def test_params(v):
    """Different parameters per sample, taken from the sample ids in the tables."""
    n = F.substring("sample_id", 2, 9).cast("int")
    return v("samples").select(
        "sample_id",
        F.when(n % 2 == 0, 5).otherwise(3).alias("leading_q"),
        F.when(n % 2 == 0, 6).otherwise(3).alias("trailing_q"),
        F.when(n % 3 == 0, "5:22").otherwise("4:20").alias("sliding"),
        F.when(n % 2 == 0, 40).otherwise(36).alias("min_len"),
    )


def _duck_trim(source: str, lead: str, trail: str, width: str, q: str, min_len: str) -> str:
    """The three cuts one after the other on lists, then the length filter."""
    return f"""t1 as (select *, coalesce(list_position(list_transform(quals, lambda x: x>={lead}), true), len(quals)+1) s from {source}),
 t2 as (select *, len(quals)+1-coalesce(list_position(list_transform(list_reverse(quals), lambda x: x>={trail}), true), len(quals)+1) e from t1),
 t3 as (select *, quals[s:e] q1 from t2),
 t4 as (select *, coalesce(list_filter(range(0, len(q1)-{width}+1), lambda i: list_sum(q1[i+1:i+{width}]) < {width}*{q})[1], len(q1)) l from t3),
 trimmed as (select sample_id, mate, read_idx, read_id, substr(seq, cast(s as int), cast(l as int)) seq, q1[1:l] quals from t4 where l>=greatest(36,{min_len}))"""


WITH_PARAMS = f"""{PARAMS}, rp as (select r.*, leading_q lq, trailing_q tq, cast(split_part(sliding,':',1) as int) w,
 cast(split_part(sliding,':',2) as int) wq, min_len ml from reads r join params using (sample_id)), {_duck_trim('rp', 'lq', 'tq', 'w', 'wq', 'ml')}"""
QSTR = "list_aggregate(list_transform(quals, lambda x: chr(x+33)),'string_agg','') qual"


def _show(df):
    return df.select("sample_id", "mate", "read_idx", "read_id", "seq", encode_phred33(F.col("quals")).alias("qual"))


@query("trim_leading", "reads", f"""with t as (select *, coalesce(list_position(list_transform(quals, lambda x: x>=20), true), len(quals)+1) s from reads)
 select sample_id, mate, read_idx, read_id, substr(seq, cast(s as int)) seq, coalesce(list_aggregate(list_transform(quals[s:], lambda x: chr(x+33)),'string_agg',''),'') qual from t""")
def _(v):
    return _show(trim.trim_leading(v("reads"), 20))


@query("trim_trailing", "reads", f"""with t as (select *, len(quals)+1-coalesce(list_position(list_transform(list_reverse(quals), lambda x: x>=24), true), len(quals)+1) e from reads)
 select sample_id, mate, read_idx, read_id, substr(seq,1,cast(e as int)) seq, coalesce(list_aggregate(list_transform(quals[1:e], lambda x: chr(x+33)),'string_agg',''),'') qual from t""")
def _(v):
    return _show(trim.trim_trailing(v("reads"), 24))


@query("trim_sliding_window", "reads", """with t as (select *, coalesce(list_filter(range(0, len(quals)-4+1), lambda i: list_sum(quals[i+1:i+4]) < 4*20)[1], len(quals)) l from reads)
 select sample_id, mate, read_idx, read_id, substr(seq,1,cast(l as int)) seq, coalesce(list_aggregate(list_transform(quals[1:l], lambda x: chr(x+33)),'string_agg',''),'') qual from t""")
def _(v):
    return _show(trim.trim_sliding_window(v("reads"), 4, 20))


@query("filter_min_length", "reads", f"select sample_id, mate, read_idx, read_id, seq, {QSTR} from reads where length(seq)>=50")
def _(v):
    return _show(trim.filter_min_length(v("reads"), 50))


@query("trim_reads", "reads", f"with {WITH_PARAMS} select sample_id, mate, read_idx, read_id, seq, {QSTR} from trimmed")
def _(v):
    return _show(trim.trim_reads(v("reads"), test_params(v)))


@query("trim_split_pairs", "reads", f"""with {WITH_PARAMS} select sample_id, mate, read_idx, length(seq) len,
 case when count(*) over (partition by sample_id, read_idx)>=2 then 'paired' else 'unpaired' end fate from trimmed""")
def _(v):
    out = trim.split_pairs(trim.trim_reads(v("reads"), test_params(v)))
    return out.select("sample_id", "mate", "read_idx", F.length("seq").cast("bigint").alias("len"), "fate")


@query("trim_summary", "reads", f"""with {WITH_PARAMS},
 u as (select sample_id, read_idx, mate, length(seq) b, 0 kept from reads union all select sample_id, read_idx, mate, length(seq), 1 from trimmed),
 p as (select sample_id, read_idx, bool_or(kept=1 and mate=1) r1, bool_or(kept=1 and mate=2) r2, sum(case when kept=0 then b else 0 end) bi,
  sum(case when kept=1 then b else 0 end) bo from u group by 1,2)
 select sample_id, count(*) pairs_in, count(*) filter (r1 and r2) both_kept, count(*) filter (r1 and not r2) r1_only,
 count(*) filter (r2 and not r1) r2_only, count(*) filter (not r1 and not r2) dropped, cast(sum(bi) as bigint) bases_in, cast(sum(bo) as bigint) bases_out,
 any_value(leading_q) leading_q, any_value(trailing_q) trailing_q, any_value(sliding) sliding, any_value(min_len) min_len
 from p join params using (sample_id) group by 1""")
def _(v):
    reads, params = v("reads"), test_params(v)
    return trim.trim_summary(reads, trim.trim_reads(reads, params), params)


@query("retrim_failed", "reads alignments", f"""with gate as (select sample_id, 100.0*count(*) filter (flag&4=0)/count(*) rate from alignments where flag&2304=0 group by 1),
 again as (select sample_id from gate where rate<85.0 and sample_id in ('S1','S2','S4','S5')), {PARAMS}, rp as (select r.*, leading_q lq, trailing_q tq, cast(split_part(sliding,':',1) as int) w,
 cast(split_part(sliding,':',2) as int) wq, min_len ml from reads r join params using (sample_id) where sample_id in (select sample_id from again)),
 {_duck_trim('rp', 'lq', 'tq', 'w', 'wq', 'ml')} select sample_id, mate, read_idx, read_id, seq, {QSTR} from trimmed""")
def _(v):
    from seqframe.operators.alignments import mapping_rate
    from seqframe.operators.decide import alignment_gate

    rates = mapping_rate(v("alignments"), digits=None)
    # external advice per sample: third replicates are not to be trimmed again
    advice = v("samples").select(
        "sample_id", F.when(F.col("replicate_group") == "3", "change_genome").otherwise("re_trim").alias("action")
    )
    gate = alignment_gate(rates, advice, minimum=85.0)
    return _show(trim.retrim_failed(v("reads"), gate, test_params(v)))
