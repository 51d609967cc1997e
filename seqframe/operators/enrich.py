"""Gene set enrichment from user-supplied annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.ordering import bh_adjust
from seqframe.functions.scratch import materialize
from seqframe.functions.skew import lookup_join
from seqframe.functions.special import hypergeom_upper_tail
from seqframe.operators.de import ALPHA, MIN_LFC, significant

MIN_SET, MAX_SET = 10, 500
P_CUT, Q_CUT = 0.05, 0.2


def significant_genes(results: DataFrame, distinct: bool = True) -> DataFrame:
    """Genes with padj < .05 and |log2FC| > 1; with repeats if ``distinct`` is off. NULL genes are dropped."""
    hits = results.filter(significant(ALPHA, MIN_LFC) & F.col("gene").isNotNull()).select("gene")
    return hits.distinct() if distinct else hits


def map_gene_ids(genes: DataFrame, idmap: DataFrame) -> DataFrame:
    """symbol, entrez of the genes the map knows; one-to-many is kept."""
    return genes.select(F.col("gene").alias("symbol")).distinct().join(idmap, "symbol").select("symbol", "entrez").distinct()


def term_closure(edges: DataFrame) -> DataFrame:
    """term, ancestor for every ancestor, the term itself included.

    Every round joins the known paths with themselves, so paths double in length
    and a graph of depth d takes about log2(d) rounds. Each round is stored, and
    the loop ends when no pair is new, which a cycle does not prevent.
    """
    links = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct()
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("term")).distinct()
    known = materialize(links)
    size = known.count()
    while True:
        further = known.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("next"))
        longer = lookup_join(known, further, ["ancestor"], "inner").select("term", F.col("next").alias("ancestor"))
        known = materialize(known.unionByName(longer).distinct())
        before, size = size, known.count()
        if size == before:
            break
    return known.unionByName(nodes.select("term", F.col("term").alias("ancestor"))).distinct()


def propagate_terms(gene_terms: DataFrame, closure: DataFrame) -> DataFrame:
    """gene, term with every ancestor of each annotated term."""
    up = lookup_join(gene_terms, closure, ["term"], "inner")
    return up.select("gene", F.col("ancestor").alias("term")).distinct()


def over_representation(
    genes: DataFrame, gene_terms: DataFrame, min_size: int = MIN_SET, max_size: int = MAX_SET
) -> DataFrame:
    """term, k, n, set_size (M), universe (N) and the hypergeometric upper-tail p of each tested set.

    ``gene_terms`` must be distinct. The universe is all annotated genes.
    """
    listed = genes.select("gene").distinct().withColumn("hit", F.lit(1))
    marked = gene_terms.join(listed, "gene", "left")
    per_term = marked.groupBy("term").agg(F.count(F.lit(1)).alias("set_size"), F.count("hit").alias("k"))
    annotated = marked.groupBy("gene").agg(F.max("hit").alias("hit"))
    sizes = annotated.agg(F.count(F.lit(1)).alias("universe"), F.count("hit").alias("n"))
    tested = per_term.filter((F.col("k") > 0) & F.col("set_size").between(min_size, max_size)).join(F.broadcast(sizes))
    p = hypergeom_upper_tail(F.col("k"), F.col("n"), F.col("set_size"), F.col("universe"))
    return tested.select("term", "k", "n", "set_size", "universe", p.alias("pvalue"))


def adjust_terms(tested: DataFrame) -> DataFrame:
    """Add p_adjust (Benjamini-Hochberg) and qvalue (scaled by the share of true nulls seen above p = 0.5)."""
    tested = materialize(tested)
    adjusted = bh_adjust(tested, "pvalue", out="p_adjust")
    nulls = tested.agg(
        F.least(F.lit(1.0), F.count_if(F.col("pvalue") > 0.5) / F.greatest(F.count(F.lit(1)) * 0.5, F.lit(1e-9))).alias("pi0")
    )
    scale = F.when(F.col("pi0") > 0, F.col("pi0")).otherwise(1.0)
    return adjusted.join(F.broadcast(nulls)).withColumn("qvalue", F.col("p_adjust") * scale).drop("pi0")


def readable_members(genes: DataFrame, gene_terms: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """term, geneID (member symbols joined by /), Count of the listed genes; sets are bounded by the size filter."""
    members = gene_terms.join(genes.select("gene").distinct(), "gene", "left_semi")
    if symbols is not None:
        members = members.join(symbols, members["gene"] == symbols["entrez"].cast("string")).select("term", F.col("symbol").alias("gene"))
    names = F.sort_array(F.collect_set("gene"))
    return members.groupBy("term").agg(F.array_join(names, "/").alias("geneID"), F.countDistinct("gene").alias("Count"))


GO_SCHEMA = (
    "ID string, Description string, GeneRatio string, BgRatio string, pvalue double, p_adjust double, qvalue double, "
    "geneID string, Count bigint"
)


def go_enrichment(
    genes: DataFrame,
    gene_terms: DataFrame,
    descriptions: DataFrame | None = None,
    min_size: int = MIN_SET,
    max_size: int = MAX_SET,
    p_cut: float = P_CUT,
    q_cut: float = Q_CUT,
) -> DataFrame:
    """The enrichment table, best term first; empty with the same columns if no gene is listed."""
    genes, gene_terms = materialize(genes), materialize(gene_terms)
    passed = adjust_terms(over_representation(genes, gene_terms, min_size, max_size)).filter(
        (F.col("pvalue") <= p_cut) & (F.col("p_adjust") <= p_cut) & (F.col("qvalue") <= q_cut)
    )
    kept_terms = gene_terms.join(passed.select("term"), "term", "left_semi")
    table = passed.join(readable_members(genes, kept_terms), "term")
    if descriptions is None:
        table = table.withColumn("Description", F.col("term"))
    else:
        table = table.join(descriptions.select("term", F.col("description").alias("Description")), "term", "left")
    return table.select(
        F.col("term").alias("ID"),
        "Description",
        F.concat_ws("/", "k", "n").alias("GeneRatio"),
        F.concat_ws("/", "set_size", "universe").alias("BgRatio"),
        "pvalue",
        "p_adjust",
        "qvalue",
        "geneID",
        "Count",
    ).orderBy("p_adjust", "pvalue", "ID")


def top_terms(go: DataFrame, n: int = 10) -> DataFrame:
    return go.orderBy("p_adjust", "pvalue", "ID").limit(n)


def evidence(
    go: DataFrame, genes: DataFrame, n_terms: int = 10, n_genes: int = 25, treatment: str = "treated", control: str = "control"
) -> DataFrame:
    """One record: contrast labels, the first terms and the first significant genes."""
    terms = top_terms(go, n_terms).agg(F.sort_array(F.collect_list(F.struct("p_adjust", "pvalue", "ID"))).alias("t"))
    first = genes.orderBy("gene").limit(n_genes).agg(F.sort_array(F.collect_list("gene")).alias("sig_genes"))
    return terms.join(F.broadcast(first)).select(
        F.lit(treatment).alias("treatment"),
        F.lit(control).alias("control"),
        F.transform("t", lambda t: t["ID"]).alias("top_go_terms"),
        "sig_genes",
    )


def go_summary(results: DataFrame, go: DataFrame) -> DataFrame:
    """One row: significant DE rows and enriched terms."""
    sig = results.agg(F.count_if(significant(ALPHA, MIN_LFC)).alias("n_sig"))
    return sig.join(F.broadcast(go.agg(F.count(F.lit(1)).alias("n_go"))))
