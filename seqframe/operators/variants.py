"""Variant tables: INFO fields, annotation, search and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.functions.skew import lookup_join
from seqframe.operators.intervals import overlap_join
from seqframe.sources.readers import last_wins

COLUMNS = ("chrom", "pos", "ref", "alt", "gene", "effect", "pathogenicity", "qual", "filter", "info")


def info_items(info: Column) -> Column:
    """(k, v) structs of the ``k=v`` items of an INFO text, split at the first ``=``; flags are left out."""
    items = F.filter(F.split(info, ";"), lambda x: F.instr(x, "=") > 0)
    return F.transform(
        items,
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")
        ),
    )


def info_map(variants: DataFrame) -> DataFrame:
    """Add ``info_map``; the last of repeated keys wins."""
    return variants.withColumn("info_map", last_wins(info_items(F.col("info"))))


def info_value(info: Column, key: str) -> Column:
    """One INFO value (the last one given) without building the map; NULL if absent or empty."""
    hits = F.regexp_extract_all(info, F.lit(f"(?:^|;){key}=([^;]*)"), F.lit(1))
    return F.nullif(F.try_element_at(hits, F.lit(-1)), F.lit(""))


def annotation_fields(variants: DataFrame) -> DataFrame:
    """Add gene, effect and pathogenicity from INFO; blanks become NA or UNKNOWN."""
    info = F.col("info")
    ann = info_value(info, "ANN")
    parts = F.split(ann, r"\|")
    field = lambda n: F.nullif(F.get(parts, F.lit(n)), F.lit(""))
    effect = F.when(ann.contains("|"), field(1)).otherwise(info_value(info, "EFFECT"))
    return variants.withColumns(
        {
            "gene": F.coalesce(info_value(info, "GENE"), field(3), F.lit("NA")),
            "effect": F.coalesce(effect, F.lit("NA")),
            "pathogenicity": F.coalesce(info_value(info, "CLNSIG"), info_value(info, "IMPACT"), F.lit("UNKNOWN")),
        }
    )


def variants_table(variants: DataFrame) -> DataFrame:
    """The ten report columns (after any key columns). In no order: :func:`in_report_order` sorts what is written out."""
    extra = [c for c in variants.columns if c not in COLUMNS]
    return annotation_fields(variants).select(*extra, *COLUMNS)


def in_report_order(table: DataFrame) -> DataFrame:
    """By chromosome as text and position."""
    return table.orderBy("chrom", "pos")


# The row that stands for an empty variant table.
PLACEHOLDER = ("chr1", 0, "N", "N", "NA", "NA", "NA", ".", ".", ".")


def variants_or_placeholder(table: DataFrame) -> DataFrame:
    """The table itself, or one placeholder row if it is empty."""
    row = F.struct(*[F.lit(v).cast(table.schema[c].dataType).alias(c) for c, v in zip(COLUMNS, PLACEHOLDER)])
    empty = table.select(*COLUMNS).limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.inline(F.array(row)))
    return table.select(*COLUMNS).unionByName(empty)


def annotate_known(variants: DataFrame, known: DataFrame) -> DataFrame:
    """Add clnsig and impact of known variants with the same place and alleles."""
    keys = ["chrom", "pos", "ref", "alt"]
    facts = known.groupBy(*keys).agg(F.max("clnsig").alias("clnsig"), F.max("impact").alias("impact"))
    return lookup_join(variants, facts, keys, "left")


def search_variants(variants: DataFrame, text: str) -> DataFrame:
    """Rows that contain ``text`` in any column, ignoring case."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in variants.columns])
    return variants.filter(F.contains(F.lower(row), F.lit(text.lower())))


def variant_summary(table: DataFrame) -> DataFrame:
    """Variants per gene, effect, pathogenicity and filter: one scan, four groupings."""
    keys = ("gene", "effect", "pathogenicity", "filter")
    pair = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("name")) for k in keys])
    return table.select(F.inline(pair)).groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ region annotation

# Region classes from most to least severe.
SEVERITY = ("CDS", "UTR", "exon", "intron", "upstream", "downstream", "intergenic")
UTRS = ("UTR", "five_prime_utr", "three_prime_utr")
FLANK = 5000


def gene_regions(features: DataFrame, flank: int = FLANK) -> DataFrame:
    """Spans with a region class: features as given, gene bodies as introns, and the flanks of genes."""
    kind = F.when(F.col("feature").isin(*UTRS), "UTR").otherwise(F.col("feature"))
    given = features.select("chrom", "gene_id", kind.alias("region"), "start_pos", "end_pos").filter(
        F.col("region").isin("CDS", "UTR", "exon")
    )
    genes = features.groupBy("chrom", "gene_id").agg(
        F.min("start_pos").alias("g0"), F.max("end_pos").alias("g1"), F.min("strand").alias("strand")
    )
    forward = F.col("strand") != "-"
    span = lambda name, a, b: F.struct(name.alias("region"), a.alias("start_pos"), b.alias("end_pos"))
    up, down = F.lit("upstream"), F.lit("downstream")
    around = genes.select(
        "chrom",
        "gene_id",
        F.inline(
            F.array(
                span(F.lit("intron"), F.col("g0"), F.col("g1")),
                span(F.when(forward, up).otherwise(down), F.greatest(F.col("g0") - flank, F.lit(1)), F.col("g0") - 1),
                span(F.when(forward, down).otherwise(up), F.col("g1") + 1, F.col("g1") + flank),
            )
        ),
    ).filter("start_pos <= end_pos")
    return given.unionByName(around)


def annotate_regions(variants: DataFrame, features: DataFrame, flank: int = FLANK) -> DataFrame:
    """Most severe region class of each place and the first gene that gives it (NULL between genes).

    Places are annotated once however many variant rows share them.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("region"))
    places = variants.select("chrom", "pos").distinct().withColumns({"start_pos": F.col("pos"), "end_pos": F.col("pos")})
    best = (
        overlap_join(places, gene_regions(features, flank))
        .groupBy("chrom", "pos")
        .agg(F.min(F.struct(rank.alias("rank"), "gene_id")).alias("best"))
        .select("chrom", "pos", F.col("best.rank").cast("int").alias("rank"), F.col("best.gene_id").alias("region_gene"))
    )
    region = F.get(F.array(*[F.lit(s) for s in SEVERITY]), F.col("rank") - 1)
    return lookup_join(variants, best, ["chrom", "pos"], "left").withColumn("region", F.coalesce(region, F.lit("intergenic"))).drop("rank")


# The standard genetic code, codons in TCAG order.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid of a codon, * for a stop, NULL if a base is unknown."""
    index = F.lit(0)
    for i in range(3):
        index = index * 4 + (F.instr(F.lit("TCAG"), F.substring(codon, i + 1, 1)) - 1)
    known = codon.rlike("^[ACGT]{3}$")
    return F.when(known, F.substring(F.lit(AMINO_ACIDS), index + 1, F.lit(1)))


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGTN", "TGCAN")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def _unit(features: DataFrame, unit: str | None) -> str:
    return unit or ("transcript_id" if "transcript_id" in features.columns else "gene_id")


def coding_sites(features: DataFrame, reference: DataFrame, chunk: int, unit: str | None = None) -> DataFrame:
    """chrom, pos, unit, strand, phase, codon of every coding base: a table of the size of the annotation.

    A base's place in the coding sequence is a running sum over the CDS spans of
    its unit (gene or transcript) from the 5' end. Spans meet the reference chunk
    by chunk and are taken apart only after that join.
    """
    unit = _unit(features, unit)
    cds = features.filter("feature = 'CDS'").select("chrom", unit, "start_pos", "end_pos", "strand").distinct()
    forward = F.col("strand") != "-"
    order = F.when(forward, F.col("start_pos")).otherwise(-F.col("end_pos"))
    upstream = W.partitionBy("chrom", unit).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    size = F.col("end_pos") - F.col("start_pos") + 1
    cds = cds.withColumn("before", F.coalesce(F.sum(size).over(upstream), F.lit(0)))
    chunk_no = F.explode(F.expr(f"sequence((start_pos - 1) div {chunk}, (end_pos - 1) div {chunk})"))
    pieces = cds.withColumn("k", chunk_no).withColumn("start0", F.col("k") * chunk)
    pieces = pieces.join(reference.select("chrom", "start0", "bases"), ["chrom", "start0"])
    lo, hi = F.greatest("start_pos", F.col("start0") + 1), F.least(F.col("end_pos"), F.col("start0") + chunk)
    text = F.substring(F.col("bases"), (lo - F.col("start0")).cast("int"), (hi - lo + 1).cast("int"))
    bases = pieces.select(
        "chrom", unit, "strand", "start_pos", "end_pos", "before", lo.alias("lo"), F.posexplode(F.split(text, "")).alias("i", "base")
    ).withColumn("pos", F.col("lo") + F.col("i"))
    inside = F.when(forward, F.col("pos") - F.col("start_pos")).otherwise(F.col("end_pos") - F.col("pos"))
    bases = bases.withColumns(
        {"coding": F.col("before") + inside, "letter": F.when(forward, F.col("base")).otherwise(complement(F.col("base")))}
    )
    # three bases per group
    three = F.sort_array(F.collect_list(F.struct("coding", "letter", "pos")))
    codons = bases.groupBy("chrom", unit, "strand", F.expr("coding div 3").alias("codon_no")).agg(three.alias("b"))
    whole = codons.filter(F.size("b") == 3).withColumn("codon", F.array_join(F.transform("b", lambda x: x["letter"]), ""))
    return whole.select("chrom", unit, "strand", "codon", F.posexplode(F.transform("b", lambda x: x["pos"])).alias("phase", "pos"))


def coding_changes(
    variants: DataFrame, features: DataFrame, reference: DataFrame, chunk: int = 65536, unit: str | None = None
) -> DataFrame:
    """synonymous, missense, stop_gained or stop_lost for single-base variants inside CDS features.

    One row a unit: each transcript if the features name them, else each gene.
    """
    unit = _unit(features, unit)
    # dealt by place before the distinct, which then meets the codons without being shuffled again
    snvs = variants.filter((F.length("ref") == 1) & (F.length("alt") == 1)).select("chrom", "pos", "ref", "alt").repartition("chrom", "pos").distinct()
    hits = snvs.join(coding_sites(features, reference, chunk, unit), ["chrom", "pos"])
    new = F.when(F.col("strand") != "-", F.col("alt")).otherwise(complement(F.col("alt")))
    changed = F.concat(
        F.substring(F.col("codon"), F.lit(1), F.col("phase")), new, F.substring(F.col("codon"), F.col("phase") + 2, F.lit(3))
    )
    was, now = amino_acid(F.col("codon")), amino_acid(changed)
    change = (
        F.when(was == now, "synonymous")
        .when(now == "*", "stop_gained")
        .when(was == "*", "stop_lost")
        .when(was.isNotNull() & now.isNotNull(), "missense")
    )
    return hits.select(
        "chrom", "pos", "ref", "alt", unit, "codon", changed.alias("new_codon"), was.alias("aa_ref"), now.alias("aa_alt"), change.alias("change")
    )


# Coding changes from most to least severe.
CHANGES = ("stop_gained", "stop_lost", "missense", "synonymous")


def consequences(variants: DataFrame, features: DataFrame, reference: DataFrame, chunk: int = 65536) -> DataFrame:
    """Add ``change``, the most severe coding change of each variant over all units, and ``change_unit``, the first unit that has it (NULL outside CDS)."""
    unit = _unit(features, None)
    rank = F.array_position(F.array(*[F.lit(c) for c in CHANGES]), F.col("change")).cast("int")
    keys = ["chrom", "pos", "ref", "alt"]
    found = coding_changes(variants, features, reference, chunk, unit).filter("change is not null")
    worst = found.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), F.col(unit).alias("unit"))).alias("worst"))
    worst = worst.select(*keys, F.get(F.array(*[F.lit(c) for c in CHANGES]), F.col("worst.rank") - 1).alias("change"), F.col("worst.unit").alias("change_unit"))
    return variants.join(worst.hint("merge"), keys, "left")  # as long as the variants


def sample_variants(variants: DataFrame) -> DataFrame:
    """Variants, distinct genes and variants by effect class of each sample, for the run report: sample_id, n_variants, n_genes, n_protein_changing."""
    changing = F.col("effect").isin("stop_gained", "stop_lost", "missense")
    gene = F.when(~F.col("gene").isin("NA", ""), F.col("gene"))
    return variants.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_variants"), F.countDistinct(gene).alias("n_genes"), F.count_if(changing).alias("n_protein_changing"))
