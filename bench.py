"""Time the headline operators on one data directory; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). The
derived sequencing views are stored first, as a user's tables would be; that step
is reported as ``stage_views`` and is not part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    from seqframe.functions.scratch import materialize, shared_dir
    from seqframe.fixtures import view
    from seqframe.operators import alignments as al
    from seqframe.operators import counts as ct
    from seqframe.operators import coverage as cv
    from seqframe.operators import de, decide, mapping, pileup, qc, recalibrate, trim
    from seqframe.operators import variants as vr
    from seqframe.plans.base_queries import CHUNK, chunks, known_sites
    from seqframe.sources import readers, sinks

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seqframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    start = time.time()
    names = ("reads", "alignments", "exons", "panel", "variants", "counts", "samples", "contig_reads", "contigs")
    v = {n: materialize(view(spark, sf_dir, n).repartition(2 * int(cpus))) for n in names}
    stage_views = round(time.time() - start, 3)
    rows = {n: v[n].count() for n in names}

    reads, rows_in, names = v["reads"], v["alignments"], v["samples"]
    fastq = shared_dir(spark)
    sinks.write_fastq(reads, fastq, compression="none")
    reference, long_reference = materialize(chunks(v.get, CHUNK)), materialize(chunks(v.get, 1000, 256))
    known = materialize(known_sites(v.get))
    table = materialize(recalibrate.base_recalibration_table(v["contig_reads"], reference, known, CHUNK))
    runs = {
        "per_base_quality": ("reads", lambda: qc.per_base_quality(qc.base_profile(reads))),
        "qc_verdict": ("reads", lambda: decide.qc_verdict(qc.qc_flags(reads))),
        "duplication_levels": ("reads", lambda: qc.duplication_levels(qc.sequence_counts(reads))),
        "trim_reads": ("reads", lambda: trim.trim_reads(reads)),
        "flagstat": ("alignments", lambda: al.flagstat(rows_in)),
        "mark_duplicates": ("alignments", lambda: al.mark_duplicates(rows_in, rows_in["qual_sum"])),
        "feature_counts": (
            "alignments",
            lambda: ct.feature_counts(ct.assign_reads(rows_in, v["exons"]), v["exons"], names),
        ),
        "depth": ("alignments", lambda: cv.depth(rows_in)),
        "region_mean_depth": ("alignments", lambda: cv.region_mean_depth(cv.depth(rows_in), v["panel"], names)),
        "variants_table": ("variants", lambda: vr.variants_table(v["variants"])),
        "size_factors": ("counts", lambda: de.size_factors(v["counts"])),
        "differential_expression": ("counts", lambda: de.differential_expression(v["counts"], v["samples"])),
        "read_fastq": ("reads", lambda: readers.read_fastq(spark, fastq, "run")),
        "map_reads": ("reads", lambda: mapping.map_reads(reads, long_reference, k=20, max_mismatch=2, chunk=1000, overlap=256)),
        "base_recalibration_table": ("contig_reads", lambda: recalibrate.base_recalibration_table(v["contig_reads"], reference, known, CHUNK)),
        "apply_recalibration": ("contig_reads", lambda: recalibrate.apply_recalibration(v["contig_reads"], table)),
        "call_variants": ("contig_reads", lambda: pileup.call_variants(pileup.pileup(v["contig_reads"]), reference, CHUNK)),
        "pileup": ("contig_reads", lambda: pileup.pileup(v["contig_reads"])),
    }
    seconds, per_second = {}, {}
    for name, (source, run) in runs.items():
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        per_second[name] = round(rows[source] / max(seconds[name], 1e-3))
    print(
        json.dumps(
            {
                "metric": "seqframe_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": per_second,
                "rows": rows,
                "stage_views": stage_views,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
