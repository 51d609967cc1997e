"""Differential expression on a long count table (gene_id, sample_id, cnt)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.functions.ordering import bh_adjust, exact_median
from seqframe.functions.scratch import materialize
from seqframe.functions.skew import lookup_join
from seqframe.operators.counts import for_each_sample

ALPHA = 0.05
MIN_LFC = 1.0
NO_GENE = "no gene is counted in every sample, so size factors are undefined"


def align_design(counts: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and samples both have, counts rounded, missing batch filled; errors if no test is possible."""
    missing = [c for c in ("sample_id", "condition") if c not in samples.columns]
    if missing:
        raise ValueError("differential expression needs a sheet with sample_id and condition")
    batch = F.coalesce("batch", F.lit("batch1")) if "batch" in samples.columns else F.lit("batch1")
    sheet = samples.select("sample_id", "condition", batch.alias("batch"))
    common = sheet.join(counts.select("sample_id").distinct(), "sample_id", "left_semi")
    seen = common.agg(F.countDistinct("sample_id").alias("n"), F.countDistinct("condition").alias("c")).first()
    if seen["n"] < 2:
        raise ValueError("fewer than two samples are both counted and listed")
    if seen["c"] < 2:
        raise ValueError("all samples are of one condition")
    rounded = counts.withColumn("cnt", F.bround(F.col("cnt").cast("double")).cast("bigint"))
    return lookup_join(rounded, common.select("sample_id").distinct(), ["sample_id"], "left_semi"), common


def contrast_levels(samples: DataFrame, contrast: tuple[str, str] | None = None) -> DataFrame:
    """One row: test level and base level. By default the second and first condition in alphabetical order."""
    if contrast is not None:
        test, base = F.lit(contrast[0]), F.lit(contrast[1])
        return samples.select("condition").distinct().agg(test.alias("test_level"), base.alias("base_level"))
    levels = F.sort_array(F.collect_set("condition"))
    return samples.agg(levels.alias("l")).select(
        F.get("l", F.lit(1)).alias("test_level"), F.get("l", F.lit(0)).alias("base_level")
    )


def size_factors(counts: DataFrame) -> DataFrame:
    """Median over genes of count / geometric mean, over the genes without a zero; an error if there is none."""
    n_samples = counts.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("n_samples"))
    log_mean = (
        counts.filter("cnt > 0")
        .groupBy("gene_id")
        .agg(F.avg(F.log("cnt")).alias("log_mean"), F.count(F.lit(1)).alias("seen"))
        .join(F.broadcast(n_samples), F.col("seen") == F.col("n_samples"))  # a one-row side
        .select("gene_id", "log_mean")
    )
    log_mean = materialize(log_mean)
    if log_mean.isEmpty():  # dropping every sample would hide that
        raise ValueError(NO_GENE)
    ratios = counts.join(log_mean, "gene_id").select("sample_id", (F.log("cnt") - F.col("log_mean")).alias("ratio"))
    return exact_median(ratios, ["sample_id"], "ratio", "m").select("sample_id", F.exp("m").alias("size_factor"))


def normalize_counts(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Add ``norm``: count / size factor."""
    joined = lookup_join(counts, factors, ["sample_id"], "inner")
    return joined.withColumn("norm", F.col("cnt") / F.col("size_factor"))


def base_mean(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("gene_id").agg(F.avg("norm").alias("baseMean"))


def trigamma(x: float) -> float:
    """Second derivative of ln Gamma, by recurrence and asymptotic series."""
    total = 0.0
    while x < 20:
        total += 1 / (x * x)
        x += 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


#: Combinations of condition and batch that a design may have: its columns, of which the model solves a dense system a gene.
MAX_CELLS = 4096


def design_cells(samples: DataFrame, contrast: tuple[str, str] | None = None):
    """The design by cells, the combinations of condition and batch: samples of a cell share a row of it.

    Returns the sheet with the ``cell`` of each sample, samples a cell, design rows (intercept, batches, conditions against the base level)
    and the column tested. Only the cells come to the driver, however many samples there are.
    """
    import numpy as np

    sheet = samples.select("sample_id", "condition", "batch").dropDuplicates(["sample_id"])
    rows = sheet.groupBy("condition", "batch").count().limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"the design has more than {MAX_CELLS} combinations of condition and batch")
    rows.sort(key=lambda r: (r["condition"], r["batch"]))
    levels = sorted({r["condition"] for r in rows})
    test, base = contrast or (levels[1], levels[0])
    batches = sorted({r["batch"] for r in rows})[1:]
    others = [test] + [c for c in levels if c not in (test, base)]
    x = np.array([[1.0, *(float(r["batch"] == b) for b in batches), *(float(r["condition"] == c) for c in others)] for r in rows])
    table = samples.sparkSession.createDataFrame([(i, r["condition"], r["batch"]) for i, r in enumerate(rows)], "cell int, condition string, batch string")
    placed = sheet.join(F.broadcast(table), ["condition", "batch"])  # at most MAX_CELLS rows
    return placed.select("sample_id", "cell"), np.array([r["count"] for r in rows], float), x, 1 + len(batches)


def _residual_basis(samples: DataFrame | None):
    """Cell of each sample, and by cell the orthonormal columns that span the design; nothing where no sample is left over to judge the spread.

    A column of the design is constant in a cell of n samples, so the basis is found among cells weighted by n. Also returns
    the number of samples.
    """
    import numpy as np

    if samples is None:
        return None, [], 0
    cells, n, x, _ = design_cells(samples)
    u, s, _ = np.linalg.svd(x * np.sqrt(n)[:, None], full_matrices=False)
    basis = (u / np.sqrt(n)[:, None])[:, s > 1e-9 * s[0]]
    total = int(n.sum())
    return (cells, basis.tolist(), total) if basis.shape[1] < total else (None, [], total)


def gene_dispersions(normalized: DataFrame, factors: DataFrame, samples: DataFrame | None = None, floor: float = 1e-8, basis=None) -> DataFrame:
    """Mean, variance and method-of-moments dispersion of each gene with a count.

    With a sheet the variance is what conditions and batches leave unexplained, over the samples less the rank of the design;
    a missing count is zero. Without one, or without replicates, it is that over all samples.
    """
    xi = factors.agg(F.avg(1 / F.col("size_factor")).alias("xi"))
    cells, columns, total = _residual_basis(samples) if basis is None else basis
    rows, variance = normalized, F.var_samp("norm")
    if columns:
        # sums of each gene and cell first, then products of those with the basis
        sums = lookup_join(normalized, cells, ["sample_id"], "inner").groupBy("gene_id", "cell").agg(
            F.sum("norm").alias("sum"), F.sum(F.col("norm") * F.col("norm")).alias("squares"), F.count(F.lit(1)).alias("n")
        )
        table = normalized.sparkSession.createDataFrame(list(enumerate(columns)), "cell int, q array<double>")
        rows = sums.join(F.broadcast(table), "cell")  # at most MAX_CELLS rows
        explained = [F.pow(F.sum(F.col("q")[k] * F.col("sum")), F.lit(2)) for k in range(len(columns[0]))]
        variance = F.greatest(reduce(sub, explained, F.sum("squares")), F.lit(0.0)) / (total - len(columns[0]))
        moments = rows.groupBy("gene_id").agg((F.sum("sum") / F.sum("n")).alias("mean"), variance.alias("var")).filter("mean > 0")
    else:
        moments = rows.groupBy("gene_id").agg(F.avg("norm").alias("mean"), variance.alias("var")).filter("mean > 0")
    mean = F.col("mean")
    raw = (F.col("var") - F.col("xi") * mean) / (mean * mean)
    return moments.join(F.broadcast(xi)).select("gene_id", "mean", "var", F.greatest(raw, F.lit(floor)).alias("disp_gene"))


def dispersion_trend(genes: DataFrame, floor: float = 1e-8) -> DataFrame:
    """One row (a0, a1) of the trend a1 / mean + a0, least squares over the genes above the floor."""
    inverse = 1 / F.col("mean")
    fit = genes.filter(F.col("disp_gene") > floor * 10).agg(
        F.regr_slope("disp_gene", inverse).alias("a1"), F.regr_intercept("disp_gene", inverse).alias("a0")
    )
    return fit.select(
        F.greatest(F.coalesce("a0", F.lit(0.0)), F.lit(1e-4)).alias("a0"),
        F.greatest(F.coalesce("a1", F.lit(0.0)), F.lit(0.0)).alias("a1"),
    )


def dispersions(normalized: DataFrame, factors: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Gene-wise, trend and shrunken dispersion per gene.

    The log dispersion of a gene is drawn towards the trend; the pull is the
    sampling variance of a log dispersion against the spread seen around the trend.
    """
    basis = _residual_basis(samples)
    free = basis[2] - len(basis[1][0]) if basis[1] else factors.select("sample_id").distinct().count() - 1
    sampling = trigamma(max(free, 1) / 2)
    genes = materialize(gene_dispersions(normalized, factors, samples, basis=basis))
    trend = dispersion_trend(genes)
    fitted = genes.join(F.broadcast(trend)).withColumn("disp_trend", F.col("a1") / F.col("mean") + F.col("a0"))
    off = F.log("disp_gene") - F.log("disp_trend")
    spread = fitted.filter("disp_gene > 1e-7").agg(
        F.greatest(F.coalesce(F.var_samp(off), F.lit(0.0)) - sampling, F.lit(0.25)).alias("prior")
    )
    weight = F.col("prior") / (F.col("prior") + sampling)
    shrunk = F.exp(weight * F.log("disp_gene") + (1 - weight) * F.log("disp_trend"))
    return fitted.join(F.broadcast(spread)).select("gene_id", "mean", "disp_gene", "disp_trend", shrunk.alias("dispersion"))


def nb_wald_test(
    counts: DataFrame,
    samples: DataFrame,
    factors: DataFrame,
    disp: DataFrame,
    contrast: tuple[str, str] | None = None,
    iterations: int = 50,
) -> DataFrame:
    """Negative binomial GLM ``~ batch + condition`` per gene and the Wald test of the condition.

    Genes are rows that hold their counts, size factors and cells of all samples, zero where a sample has no count; one Arrow batch of
    genes is fitted at once with NumPy (iteratively reweighted least squares). What a gene's samples add to the normal
    equations is summed by cell, so the design is never spread out over samples.
    """
    cells, per_cell, design, tested = design_cells(samples, contrast)
    known = materialize(cells.join(factors.select("sample_id", F.log("size_factor").alias("o")), "sample_id"))
    genes = disp.select("gene_id", "mean", "dispersion")
    grid = for_each_sample(materialize(genes).select("gene_id"), known)
    full = grid.join(counts.select("gene_id", "sample_id", F.col("cnt").cast("double").alias("c")), ["gene_id", "sample_id"], "left")
    # as long as the sheet, like a row of the count matrix
    per_gene = full.groupBy("gene_id").agg(F.collect_list(F.struct("cell", "o", F.coalesce("c", F.lit(0.0)).alias("c"))).alias("x"))
    ready = per_gene.join(genes, "gene_id").select("gene_id", "mean", "dispersion", F.col("x.cell").alias("cell"), F.col("x.o").alias("o"), F.col("x.c").alias("c"))

    def fit(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        x, n, p = np.asarray(design), np.asarray(per_cell), design.shape[1]
        ridge = 1e-6 * np.eye(p)
        outer = np.einsum("ci,cj->cij", x, x)
        inverse = np.linalg.pinv(np.einsum("c,cij->ij", n, outer))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            cell, offset, y = (np.stack(pdf[c].to_numpy()) for c in ("cell", "o", "c"))
            alpha = pdf["dispersion"].to_numpy()[:, None]
            at = (np.arange(len(y))[:, None] * len(x) + cell).ravel()

            def by_cell(values):
                return np.bincount(at, weights=values.ravel(), minlength=len(y) * len(x)).reshape(len(y), len(x))

            def spread(beta):
                return np.take_along_axis(beta @ x.T, cell, axis=1)

            def normal(mu):
                return np.einsum("gc,cij->gij", by_cell(mu / (1 + alpha * mu)), outer) + ridge

            beta = by_cell(np.log(y / np.exp(offset) + 0.1)) @ x @ inverse
            open_ = np.ones(len(y), bool)  # genes not yet settled; each stops by itself
            for _ in range(iterations):
                eta = spread(beta)
                mu = np.exp(np.clip(eta + offset, -30, 30))
                xtwz = by_cell(mu / (1 + alpha * mu) * (eta + (y - mu) / mu)) @ x
                new = np.clip(np.linalg.solve(normal(mu), xtwz[..., None])[..., 0], -30, 30)
                moved = np.max(np.abs(new - beta), axis=1) >= 1e-8
                beta = np.where(open_[:, None], new, beta)
                open_ &= moved
                if not open_.any():
                    break
            mu = np.exp(np.clip(spread(beta) + offset, -30, 30))
            se = np.sqrt(np.linalg.inv(normal(mu))[:, tested, tested]) / math.log(2)
            lfc = beta[:, tested] / math.log(2)
            stat = lfc / se
            yield pd.DataFrame(
                {
                    "gene": pdf["gene_id"],
                    "baseMean": pdf["mean"],
                    "log2FoldChange": lfc,
                    "lfcSE": se,
                    "stat": stat,
                    "pvalue": [math.erfc(abs(s) / math.sqrt(2)) for s in stat],
                }
            )

    schema = "gene string, baseMean double, log2FoldChange double, lfcSE double, stat double, pvalue double"
    return ready.mapInPandas(fit, schema)


def de_results(tested: DataFrame) -> DataFrame:
    """The seven result columns, adjusted p ascending, NULL last."""
    columns = ["gene", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue", "padj"]
    adjusted = bh_adjust(tested)
    shown = [F.col(c) if c in adjusted.columns else F.lit(None).cast("double").alias(c) for c in columns]
    return adjusted.select(*shown).orderBy(F.asc_nulls_last("padj"), "gene")


def differential_expression(counts: DataFrame, samples: DataFrame, contrast: tuple[str, str] | None = None) -> DataFrame:
    """Counts and sheet to the result table; tables that later steps share are stored once."""
    cnt, sheet = align_design(counts, samples)
    cnt = materialize(cnt)
    factors = materialize(size_factors(cnt))
    disp = dispersions(normalize_counts(cnt, factors), factors, sheet)
    return de_results(materialize(nb_wald_test(cnt, sheet, factors, disp, contrast)))


def significant(alpha: float = ALPHA, lfc: float | None = None) -> Column:
    hit = F.coalesce(F.col("padj") < alpha, F.lit(False))
    return hit if lfc is None else hit & (F.abs(F.col("log2FoldChange")) > lfc)


def de_significant(results: DataFrame, alpha: float = ALPHA, lfc: float | None = None) -> DataFrame:
    """Adjusted p below ``alpha``, and with ``lfc`` also a fold change beyond it."""
    return results.filter(significant(alpha, lfc))


def pc1_warning(pc1_variance: Column) -> Column:
    """Warnings of a run: a first component that explains less than half."""
    none = F.array().cast("array<string>")
    return F.when(pc1_variance < 50, F.array(F.lit("PC1 variance below 50%"))).otherwise(none)


def de_summary(results: DataFrame, pca_variance: DataFrame | None = None) -> DataFrame:
    """One row: genes tested, significant, up, down, and the PC1 share with its warnings."""
    up = significant() & (F.col("log2FoldChange") > 0)
    down = significant() & (F.col("log2FoldChange") < 0)
    out = results.agg(
        F.count(F.lit(1)).alias("n_genes_tested"),
        F.count_if(significant()).alias("n_sig"),
        F.count_if(up).alias("n_up"),
        F.count_if(down).alias("n_down"),
    )
    if pca_variance is None:
        return out
    pc1 = pca_variance.filter("pc = 1").agg(F.max("percent_var").alias("pc1_variance"))
    return out.join(F.broadcast(pc1)).withColumn("warnings", pc1_warning(F.col("pc1_variance")))


def variance_stabilize(normalized: DataFrame, trend: DataFrame) -> DataFrame:
    """Add ``vst``: the closed-form transform for a dispersion trend a1 / mean + a0."""
    q, a0, a1 = F.col("norm"), F.col("a0"), F.col("a1")
    value = F.log2((1 + a1 + 2 * a0 * q + 2 * F.sqrt(a0 * q * (1 + a1 + a0 * q))) / (4 * a0))
    return normalized.join(F.broadcast(trend)).withColumn("vst", value).drop("a0", "a1")


def top_variable_genes(vst: DataFrame, n: int = 50) -> DataFrame:
    """The n genes with the highest variance over samples (ties by name)."""
    variance = vst.groupBy("gene_id").agg(F.var_samp("vst").alias("variance"))
    return variance.orderBy(F.col("variance").desc_nulls_last(), "gene_id").limit(n)


def row_zscore(vst: DataFrame) -> DataFrame:
    """(x - mean) / sd within each gene, sample sd."""
    stats = vst.groupBy("gene_id").agg(F.avg("vst").alias("_m"), F.stddev_samp("vst").alias("_s"))
    z = (F.col("vst") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return vst.join(stats, "gene_id").withColumn("zscore", z).drop("_m", "_s")


def sample_pca(vst: DataFrame, ntop: int = 500, components: int = 2) -> DataFrame:
    """sample_id, pc, score, percent_var from the ``ntop`` most variable genes.

    Each task sums its samples into a genes x genes product matrix, so the number of samples is free; ``ntop`` bounds what is
    held. A component's sign makes its largest score positive.
    """
    top = top_variable_genes(vst, ntop).select("gene_id").coalesce(1).sortWithinPartitions("gene_id")
    order = materialize(top.withColumn("i", F.monotonically_increasing_id()))  # at most ntop rows
    chosen = lookup_join(vst, order, ["gene_id"], "inner")
    means = chosen.groupBy("gene_id").agg(F.avg("vst").alias("m"))
    centred = materialize(lookup_join(chosen, means, ["gene_id"], "inner").select("sample_id", "i", (F.col("vst") - F.col("m")).alias("x")))
    n = order.count()
    cells = centred.groupBy("sample_id").agg(F.collect_list(F.struct("i", "x")).alias("cells"))

    def products(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        gram = np.zeros((n, n))
        for pdf in batches:
            rows = np.zeros((len(pdf), n))
            at, x = np.concatenate([*pdf["i"], []]).astype(int), np.concatenate([*pdf["x"], []])
            rows[np.repeat(np.arange(len(pdf)), pdf["i"].map(len)), at] = x
            gram += rows.T @ rows
        i, j = np.nonzero(gram)
        yield pd.DataFrame({"i": i, "j": j, "x": gram[i, j]})

    parts = cells.select(F.col("cells.i").alias("i"), F.col("cells.x").alias("x")).mapInPandas(products, "i int, j int, x double")
    loadings, shares = _axes(parts.groupBy("i", "j").agg(F.sum("x").alias("x")), n, components)
    spark = vst.sparkSession
    table = spark.createDataFrame([(g, k + 1, float(w)) for k, v in enumerate(loadings) for g, w in enumerate(v)], "i long, pc int, w double")
    share = spark.createDataFrame([(k + 1, s) for k, s in enumerate(shares)], "pc int, percent_var double")
    scores = centred.join(F.broadcast(table), "i").groupBy("sample_id", "pc").agg(F.sum(F.col("x") * F.col("w")).alias("raw"))
    scores = materialize(scores)
    sign = scores.groupBy("pc").agg(F.max(F.struct(F.round(F.abs("raw"), 9).alias("a"), F.signum("raw").alias("s"))).alias("top"))
    sign = sign.select("pc", F.when(F.col("top.s") < 0, -1.0).otherwise(1.0).alias("sign"))
    return scores.join(F.broadcast(sign), "pc").join(F.broadcast(share), "pc").select("sample_id", "pc", (F.col("raw") * F.col("sign")).alias("score"), "percent_var")


def _axes(gram: DataFrame, n: int, components: int) -> tuple[list, list[float]]:
    """Leading eigenvectors of an n x n product matrix and the percentages of variance along them."""
    import numpy as np

    total = np.zeros((n, n))
    for r in gram.toLocalIterator():
        total[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh(total) if n else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    whole = values.sum()
    keep = range(min(components, n))
    return [vectors[:, k] for k in keep], [float(round(100 * values[k] / whole)) if whole > 0 else 0.0 for k in keep]


def ma_table(results: DataFrame) -> DataFrame:
    return results.select(
        "gene",
        F.when(F.col("baseMean") > 0, F.log10("baseMean")).alias("log10_base_mean"),
        "log2FoldChange",
        significant().alias("sig"),
    )


def volcano_table(results: DataFrame, p_cut: float = ALPHA, fc_cut: float = MIN_LFC, n_labels: int = 10) -> DataFrame:
    """-log10(padj), class by both cut-offs, and labels for the first ``n_labels`` genes by padj."""
    top = results.filter("padj is not null").orderBy("padj", "gene").limit(n_labels).select("gene", F.lit(True).alias("_top"))
    by_p, by_fc = significant(p_cut), F.abs(F.col("log2FoldChange")) > fc_cut
    label = F.when(F.col("_top"), F.col("gene"))
    return results.join(F.broadcast(top), "gene", "left").select(  # at most n_labels rows
        "gene",
        "log2FoldChange",
        F.when(F.col("padj") > 0, -F.log10("padj")).alias("neg_log10_padj"),
        F.when(by_p & by_fc, "p_and_log2FC").when(by_p, "p").when(by_fc, "log2FC").otherwise("NS").alias("class"),
        label.alias("label"),
    )
