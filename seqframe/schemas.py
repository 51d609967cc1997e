"""Explicit schemas of the tables; readers never infer types."""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


READS = _struct(sample_id=STRING, mate=INT, read_idx=LONG, read_id=STRING, seq=STRING, quals=T.ArrayType(INT))
ALIGNMENTS = _struct(
    sample_id=STRING, qname=STRING, flag=INT, chrom=STRING, pos=LONG, mapq=INT, cigar=STRING, rnext=STRING,
    pnext=LONG, tlen=LONG, seq=STRING, qual=STRING, tags=T.MapType(STRING, STRING),
)
FEATURES = _struct(
    chrom=STRING, source=STRING, feature=STRING, start_pos=LONG, end_pos=LONG, score=STRING, strand=STRING,
    frame=STRING, attrs=T.MapType(STRING, STRING), gene_id=STRING,
)
REGIONS = _struct(chrom=STRING, start0=LONG, end0=LONG, name=STRING, region=STRING)
VARIANTS = _struct(chrom=STRING, pos=LONG, ref=STRING, alt=STRING, qual=STRING, filter=STRING, info=STRING)
SAMPLES = _struct(
    sample_id=STRING, condition=STRING, replicate_group=STRING, species=STRING, batch=STRING, fastq=STRING,
    fastq_r1=STRING, fastq_r2=STRING,
)
DE_RESULTS = _struct(
    gene=STRING, baseMean=DOUBLE, log2FoldChange=DOUBLE, lfcSE=DOUBLE, stat=DOUBLE, pvalue=DOUBLE, padj=DOUBLE
)
COVERAGE = _struct(gene=STRING, region=STRING, mean_depth=DOUBLE)
