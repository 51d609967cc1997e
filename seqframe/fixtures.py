"""Sequencing-shaped views over the test tables, once for Spark and once for DuckDB.

``view(spark, sf_dir, name)`` gives the DataFrame; ``with_views(sql, names)``
puts the same views in front of a DuckDB query as common table expressions.
Every view covers its whole source table and whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTNACGTACNGN"

_GENE = "concat('G',cast(floor(p_partkey/10) as int))"
_GENE_NO = "cast(floor(p_partkey/10) as int)"
_QUAL = (
    "cast(case when p<=3 and doc_id%6=0 then 2 else greatest(2, 40 - cast(floor(p*p/400) as int)"
    " - (ascii(substr(t,p,1))*7+doc_id+p)%12) end as int)"
)
_ALT = "translate(substr(t,p,1),'ACGT','GTAC')"
_CIGAR = """case l_partkey%5 when 2 then concat('10M100N',29+15*l_linenumber-9,'M')
 when 3 then concat('5S',25+15*l_linenumber,'M') when 4 then concat('10M2D5M1I',14+15*l_linenumber,'M')
 else concat(30+15*l_linenumber,'M') end"""

# name -> SQL that reads the same in both engines
SHARED = {
    # l_partkey%5 picks the CIGAR shape; qname is not unique
    "alignments": f"""select concat('q',l_orderkey,'_',l_linenumber) qname, concat('S',l_orderkey%6+1) sample_id,
 cast((case l_returnflag when 'A' then 0 when 'R' then 16 else (case when l_linestatus='O' then 0 else 4 end) end)
 + (case when l_orderkey%89=0 then 256 else 0 end) + (case when l_orderkey%97=0 then 1024 else 0 end)
 + (case when l_orderkey%3=0 then 1 + (case when l_linenumber%2=0 then 64 else 128 end)
 + (case when l_suppkey%4=0 then 2 else 0 end) + (case when l_suppkey%11=0 then 8 else 0 end) else 0 end)
 + (case when l_orderkey%101=0 then 512 else 0 end) as int) flag,
 concat('chr',l_suppkey%5+1) chrom, cast(l_partkey*50 + cast(l_quantity as int) as bigint) pos,
 cast(round(l_discount*600) as int) mapq, {_CIGAR} cigar,
 case when l_orderkey%7=0 then concat('chr',l_partkey%5+1) else '=' end rnext,
 cast(l_partkey*50 + cast(floor(l_extendedprice) as int)%400 as bigint) pnext,
 30+15*l_linenumber read_len, cast(case when l_suppkey%13=0 then 2 else 1 end as int) nh,
 concat('lib',l_suppkey%3) library, cast(floor(l_extendedprice) as bigint) qual_sum from lineitem""",
    "exons": f"""select {_GENE} gene_id, concat('chr',cast(floor(p_partkey/50) as int)%5+1) chrom, 'exon' feature,
 cast(p_partkey*50+1 as bigint) start_pos, cast(p_partkey*50+20+p_size+(case when p_partkey%10=9 then 100 else 0 end) as bigint) end_pos,
 case when p_size%2=0 then '+' else '-' end strand from part""",
    "panel": """select concat('chr',s_suppkey%5+1) chrom, cast(s_suppkey*900 as bigint) start0, cast(s_suppkey*900+500 as bigint) end0,
 s_name name from supplier""",
    "variants": """select concat('chr',o_custkey%5+1) chrom, cast(o_orderkey%100000+1 as bigint) pos,
 substr('ACGT',cast(o_orderkey%4 as int)+1,1) ref, substr('CGTA',cast(o_orderkey%4 as int)+1,1) alt,
 cast(cast(floor(o_totalprice) as int)%99 as string) qual, case when o_orderpriority='5-LOW' then 'LowQual' else 'PASS' end as filter,
 concat('DP=',o_custkey%80, case when o_orderstatus='F' then concat(';GENE=G',o_custkey%200) else '' end,
 case when o_orderstatus='P' then concat(';ANN=',substr('CGTA',cast(o_orderkey%4 as int)+1,1),'|missense_variant|MODERATE|G',o_custkey%200,'|') else '' end,
 case when o_orderkey%7=0 then ';CLNSIG=Pathogenic' when o_orderkey%5=0 then ';IMPACT=HIGH' else '' end,
 case when o_orderkey%3=0 then concat(';DB;DP=',o_custkey%7) else '' end) info from orders""",
    "counts": """select concat('G',cast(floor(l_partkey/10) as int)) gene_id, concat('S',l_orderkey%6+1) sample_id,
 cast(sum(l_quantity) as bigint) cnt from lineitem group by 1,2""",
    "samples": """select concat('S',i) sample_id, case when i<=3 then 'control' else 'treated' end condition,
 case when i%2=0 then 'b1' else 'b2' end batch, cast((i-1)%3+1 as string) replicate_group
 from (select distinct cast(l_orderkey%6+1 as int) i from lineitem) t""",
    # a sheet as users write it: repeated ids, blank ids, missing files
    "sheet": """select c_custkey row_no, case when c_custkey%50=0 then '' else concat('P',c_nationkey,'_',cast(floor(c_acctbal) as int)) end sample_id,
 case when c_mktsegment='BUILDING' then cast(null as string) else lower(c_mktsegment) end condition,
 case when c_nationkey%4=0 then cast(null as string) else concat('rep',c_nationkey%3) end replicate_group,
 case when c_nationkey%6=0 then cast(null as string) else 'mouse' end species,
 case when c_custkey%9=0 then '' else concat(c_name,'.fastq') end fastq,
 case when c_custkey%10=0 then cast(null as string) else concat(c_name,'_1.fastq') end fastq_r1,
 concat(c_name,'_2.fastq') fastq_r2 from customer""",
    "gene_terms": f"select distinct {_GENE} gene, concat('T:',p_brand,'/',p_type) term from part",
    "term_edges": """select distinct concat('T:',p_brand,'/',p_type) child, concat('T:',p_type) parent from part
 union select distinct concat('T:',p_brand,'/',p_type) child, concat('T:',p_brand) parent from part
 union select distinct concat('T:',p_type) child, 'T:ROOT' parent from part
 union select distinct concat('T:',p_brand) child, 'T:ROOT' parent from part""",
    "idmap": f"select distinct {_GENE} symbol, cast(100000+{_GENE_NO} as int) entrez from part where p_size > 40",
    "de_raw": f"""select {_GENE} gene, round(avg(p_retailprice),4) baseMean,
 round(cast(max(p_size)-min(p_size)-40 as double)/5,4) log2FoldChange,
 case when {_GENE_NO}%13=0 then null else round(cast(({_GENE_NO}*37)%1000 as double)
 /(case when {_GENE_NO}%4=0 then 100000 else 1000 end)+cast(0.00001 as double),6) end pvalue from part group by floor(p_partkey/10)""",
    "known_sites": """select distinct concat('chr',o_custkey%5+1) chrom, cast(o_orderkey%100000+1 as bigint) pos
 from orders where o_orderpriority='1-URGENT'""",
    "known_variants": """select concat('chr',o_custkey%5+1) chrom, cast(o_orderkey%100000+1 as bigint) pos,
 substr('ACGT',cast(o_orderkey%4 as int)+1,1) ref, substr('CGTA',cast(o_orderkey%4 as int)+1,1) alt,
 max(case when o_orderstatus='F' then 'Benign' else 'Pathogenic' end) clnsig,
 max(case when o_totalprice>200000 then 'HIGH' else 'LOW' end) impact
 from orders where o_orderpriority='1-URGENT' group by 1,2,3,4""",
    "stage_results": """select concat('run',user_id%7) run_id, concat('S',user_id%6+1) sample_id, event_id,
 case event_type when 'signup' then 'ingest' when 'view' then 'qc' when 'click' then 'trim' when 'purchase' then 'align' else 'count' end stage,
 case when value<5 then cast(null as string) when event_id%10=0 then 'warn' else 'ok' end status,
 case when value<2 then cast(null as string) else concat(event_type,' done') end reasoning,
 event_id%50=0 halt, case when event_id%100=0 then 'Coverage below threshold' else '' end halt_reason,
 case when event_id%17=0 then 1 else 0 end returncode from events""",
    # the same results by user, some of whom never halt
    "user_results": """select concat('run',user_id%7) run_id, concat('U',user_id) sample_id, event_id,
 case event_type when 'signup' then 'ingest' when 'view' then 'qc' when 'click' then 'trim' when 'purchase' then 'align' else 'count' end stage,
 case when value<5 then cast(null as string) when event_id%10=0 then 'warn' else 'ok' end status,
 case when value<2 then cast(null as string) else concat(event_type,' done') end reasoning,
 event_id%50=0 halt, case when event_id%100=0 then 'Coverage below threshold' else '' end halt_reason,
 case when event_id%17=0 then 1 else 0 end returncode from events""",
    "module_flags": """select concat('U',user_id) sample_id, concat('module ',event_type) module,
 case when value<1 then 'FAIL' when value<4 then 'WARN' else 'PASS' end status from events""",
    "verdict_json": """select doc_id, case when doc_id%5=0 then text else concat('note {"verdict":"',
 case doc_id%4 when 0 then 'PASS' when 1 then 'Trim-Needed' when 2 then 'unusable' else 'maybe' end,
 '","reasoning":"r","quality_summary":"s","confidence":', cast(cast(doc_id%15 as double)/10 as string), '}') end raw from documents""",
    "trim_requests": """select p_partkey request_id, case when p_size%9=0 then cast(null as string) when p_size%11=0 then 'x' else cast(p_size-5 as string) end leading_q,
 cast(p_size as string) trailing_q, case when p_size%5=0 then 'bad' when p_size%7=0 then cast(null as string) else concat('4:',p_size) end sliding,
 cast(p_size*6 as string) min_len from part""",
}

_TEXT = {
    "spark": "select doc_id, source, upper(regexp_replace(text,'[^A-Za-z]+','')) t from documents",
    "duck": "select doc_id, source, upper(regexp_replace(text,'[^A-Za-z]','','g')) t from documents",
}


def _windows(engine: str, stride: int, dna: bool, width: int = 100) -> str:
    """All windows of up to ``width`` letters, every ``stride`` letters, of every text."""
    text = _TEXT[engine]
    t = f"translate(t,'{LETTERS}','{BASES}')" if dna else "t"
    if engine == "spark":
        pieces = f"'.{{1,{width}}}', 0" if width == stride else f"'(?=(.{{1,{width}}})).{{1,{stride}}}', 1"
        return f"""select doc_id, source, i, t from (select doc_id, source, {t} letters from ({text}) q where length(t)>0) d
 lateral view posexplode(regexp_extract_all(letters, {pieces})) x as i, t"""
    return f"""select doc_id, source, cast(i as int) i, substr({t}, cast(i as int)*{stride}+1, {width}) t from (select * from ({text}) q where length(t)>0) d,
 unnest(range(0, cast(floor((length(t)-1)/{stride}) as int)+1)) x(i)"""


def _map(engine: str, expr: str) -> str:
    if engine == "spark":
        return f"transform(sequence(1,length(t)), p -> {expr})"
    return f"list_transform(range(1,length(t)+1), lambda p: {expr})"


def _by_letter(engine: str, expr: str) -> str:
    """``expr`` of each place p and its letter, which Spark takes from the split text and does not look up from the start of the text."""
    if engine == "spark":
        return f"transform(split(t,''), (c, k) -> {re.sub(r'\bp\b', '(k+1)', expr.replace('substr(t,p,1)', 'c'))})"
    return _map(engine, expr)


def _once(engine: str, expr: str, name: str) -> str:
    """A computed column later steps read but do not compute again (as if stored)."""
    return f" lateral view explode(array({expr})) {name}_row as {name}" if engine == "spark" else ""


def _column(engine: str, expr: str, name: str) -> str:
    return name if engine == "spark" else f"{expr} {name}"


def _reads(engine: str) -> str:
    """For Spark without the qualities, which :func:`_qualities` gives: they are left out where no step reads them."""
    quals = "doc_id, t" if engine == "spark" else f"{_map(engine, _QUAL)} quals"
    return f"""select concat('S',doc_id%6+1) sample_id, cast(i%2+1 as int) mate, cast(doc_id*1000000 + floor(i/2) as bigint) read_idx,
 concat('r',doc_id,'.',i) read_id, translate(t,'{LETTERS}','{BASES}') seq, {quals}
 from ({_windows(engine, 100, False)}) w"""


def _qualities() -> Column:
    """``_QUAL`` of every letter of ``t``, a batch of reads at a time."""

    def quals(text: pa.Array, doc_id: pa.Array) -> pa.Array:
        letters = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8).astype(np.int64)
        to = np.r_[0, np.cumsum([len(t) for t in text.to_pylist()], dtype=np.int64)]
        doc = np.repeat(doc_id.to_numpy(), np.diff(to))
        p = np.arange(len(letters)) - np.repeat(to[:-1], np.diff(to)) + 1
        q = np.maximum(2, 40 - p * p // 400 - np.fmod(letters * 7 + doc + p, 12))
        q = np.where((p <= 3) & (doc % 6 == 0), 2, q)
        return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(q.astype(np.int32)))

    return F.arrow_udf(quals, "array<int>")("t", "doc_id")


def _contigs(engine: str) -> str:
    return f"select concat('c',doc_id) chrom, translate(t,'{LETTERS}','{BASES}') bases from ({_TEXT[engine]}) q where length(t)>0"


def _contig_reads(engine: str) -> str:
    """Windows of the contigs with substitutions: fixed sites (shared by all reads) and read errors."""
    join = "array_join" if engine == "spark" else "array_to_string"
    base = f"case when (i*50+p)*31%97=0 or ((i*50+p)*7+i*13)%61=0 then {_ALT} else substr(t,p,1) end"
    quals = _by_letter(engine, "cast(greatest(2, 38 - cast(floor(p/8) as int) - (ascii(substr(t,p,1))*5+i+p)%9) as int)")
    seq = f"{join}({_map(engine, base)},'')"
    if engine == "spark":  # the same bases: the rules pick two places each of up to 100, the others stay as they are
        seq = "t"
        for first, step in (("(i*47+96)%97+1", 97), ("(i*44+60)%61+1", 61)):
            for place in (first, f"{first}+{step}"):
                seq = f"overlay({seq} placing {_ALT.replace('t,p,1', f't,{place},1')} from {place})"
    return f"""select concat('m',doc_id,'.',i) read_id, concat('S',doc_id%6+1) sample_id, concat('rg',i%2) read_group,
 cast(case when i%2=0 then 0 else 16 end as int) flag, concat('c',doc_id) chrom, cast(i*50+1 as bigint) pos, cast(60 as int) mapq,
 concat(length(t),'M') cigar, {_column(engine, seq, "seq")}, {_column(engine, quals, "quals")}
 from ({_windows(engine, 50, True)}) w{_once(engine, seq, "seq")}{_once(engine, quals, "quals")}"""


def _paired(engine: str) -> str:
    """Mates from both ends of fragments of some 270 to 300 letters: some swapped, some alone, some second mates with an error
    every 17 letters, some that fit nowhere."""
    join = "array_join" if engine == "spark" else "array_to_string"
    frag = "substr(t,1,cast(length(t)-(i*13+doc_id)%31*(case when length(t)>200 then 1 else 0 end) as int))"
    back = "reverse(translate(t,'ACGTN','TGCAN'))"
    wrong = f"{join}({_map(engine, f'case when p%17=5 then {_ALT} else substr(t,p,1) end')},'')"
    if engine == "spark":  # the first 90 letters, all that is kept, with the same errors
        wrong = "substr(t,1,90)"
        for place in range(5, 91, 17):
            wrong = f"overlay({wrong} placing {_ALT.replace('t,p,1', f't,{place},1')} from {place})"
    return f"""select sample_id, read_idx, cast(mate as int) mate, concat(read_idx,'/',mate) read_id, case when near then substr({wrong},1,90) else substr(t,1,90) end seq
 from (select sample_id, read_idx, mate, mate=2 and i%7=3 near, case when mate=2 and i%11=5 then reverse(t) when (mate=1)=(i%13=7) then {back} else t end t
 from (select concat('S',doc_id%6+1) sample_id, cast(doc_id*1000000+i as bigint) read_idx, i, {frag} t from ({_windows(engine, 150, True, 300)}) w) f,
 (values (1),(2)) m(mate) where i%17<>9 or mate=1) y"""


_DEEP_BASE = "substr('ACGT', cast((x*7 + floor(x/3))%4 as int)+1, 1)"


def _deep_contigs(engine: str) -> str:
    join = "array_join" if engine == "spark" else "array_to_string"
    bases = _map(engine, _DEEP_BASE.replace("x", "p")).replace("length(t)", "140")
    return f"select concat('d',k) chrom, {join}({bases},'') bases from (select distinct l_suppkey%4 k from lineitem) c"


def _deep_seq() -> str:
    """The bases of a read of ``_deep_reads``: 40 letters from ``pos`` on, of which at most one is an error, as those are 53 apart."""

    def letters(a: int, other: int) -> str:
        rules = ((11, 3, 1 + a), (13, 5, a), (17, 4, 2))
        shift = lambda x: next((s for step, rest, s in rules if x % step == rest), other)
        return "".join("ACGT"[(x * 7 + x // 3 + shift(x)) % 4] for x in range(1, 140))

    own, wrong = (f"case when a=0 then '{letters(0, other)}' else '{letters(1, other)}' end" for other in (0, 3))
    error = "cast((53-(l_orderkey+pos)%53)%53 as int)"  # letters before the first error
    read = f"substr({own}, cast(pos as int), 40)"
    return f"case when {error}<40 then overlay({read} placing substr({wrong}, cast(pos as int)+{error}, 1) from {error}+1) else {read} end"


def _deep_reads(engine: str) -> str:
    """Reads of 40 bases piled up on four short contigs: sites of two other alleles, of one, and errors."""
    join = "array_join" if engine == "spark" else "array_to_string"
    shift = "case when x%11=3 then 1+a when x%13=5 then a when x%17=4 then 2 when (l_orderkey+x)%53=0 then 3 else 0 end"
    letter = f"substr('ACGT', cast((x*7 + floor(x/3) + {shift})%4 as int)+1, 1)"
    seq = f"{join}({_map(engine, letter.replace('x', '(pos+p-1)')).replace('length(t)', '40')},'')"
    quals = _map(engine, "cast(20+(p+l_linenumber)%17 as int)").replace("length(t)", "40")
    if engine == "spark":  # the same letters and qualities, cut out of stretches that are written once
        seq, quals = _deep_seq(), f"slice(array({','.join(str(20 + i % 17) for i in range(1, 57))}), cast(l_linenumber%17+1 as int), 40)"
    return f"""select concat('z',l_orderkey,'_',l_linenumber) read_id, concat('S',l_orderkey%3) sample_id, cast(case when l_linenumber%2=0 then 0 else 16 end as int) flag,
 concat('d',l_suppkey%4) chrom, pos, cast(60 as int) mapq, '40M' cigar, {_column(engine, seq, "seq")}, {_column(engine, quals, "quals")}
 from (select *, cast(l_partkey%100+1 as bigint) pos, cast(floor(l_extendedprice) as bigint)%2 a from lineitem) w{_once(engine, seq, "seq")}{_once(engine, quals, "quals")}"""


BUILT = {"deep_contigs": _deep_contigs, "deep_reads": _deep_reads, "paired": _paired, "reads": _reads, "contigs": _contigs, "contig_reads": _contig_reads}

TABLES = {
    "alignments": "lineitem", "exons": "part", "panel": "supplier", "variants": "orders", "counts": "lineitem",
    "samples": "lineitem", "sheet": "customer", "gene_terms": "part", "term_edges": "part", "idmap": "part",
    "de_raw": "part", "known_sites": "orders", "known_variants": "orders", "stage_results": "events", "user_results": "events",
    "module_flags": "events", "verdict_json": "documents", "trim_requests": "part", "reads": "documents",
    "contigs": "documents", "contig_reads": "documents", "paired": "documents",
    "deep_contigs": "lineitem", "deep_reads": "lineitem",
}


def _table(spark: SparkSession, sf_dir: str, name: str, row_id: bool) -> DataFrame:
    """One input table; a file of very few row groups is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if row_id:
        # taken at the scan, so a retried task numbers its rows alike
        df = df.withColumn("_row", F.monotonically_increasing_id())
    cores = spark.sparkContext.defaultParallelism
    key = {"documents": "doc_id", "lineitem": "l_orderkey"}.get(name)
    if key and df.rdd.getNumPartitions() < 2 * cores:
        df = df.repartition(2 * cores, key)
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    row_id = name == "alignments"
    df = _table(spark, sf_dir, table, row_id)
    sql = BUILT[name]("spark") if name in BUILT else SHARED[name]
    if row_id:
        sql = sql.replace("select concat('q'", "select _row aln_id, concat('q'", 1)
    marked = sql.replace("{", "{{").replace("}", "}}").replace(f"from {table}", "from {source_table}")
    out = spark.sql(marked, source_table=df)
    return out.withColumn("quals", _qualities()).drop("doc_id", "t") if name == "reads" else out


def with_views(names: str, sql: str) -> str:
    """DuckDB text: the named views (space separated) as CTEs, then ``sql``."""
    ctes = []
    for name in names.split():
        body = BUILT[name]("duck") if name in BUILT else SHARED[name]
        if name == "alignments":
            body = body.replace("select concat('q'", "select row_number() over () aln_id, concat('q'", 1)
        ctes.append(f"{name} as materialized ({body})")
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
