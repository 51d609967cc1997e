"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import decontaminate, exact, katz, language, licenses, lines, mixing, near, oracles, periodic, repeats, turns, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_katz_score")
def katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language.fold(F.col("doc_id"), 7, 2)
    scored = katz.score_texts(_table(spark, sf_dir, "documents"), ~held)
    return scored.withColumn("train", held).withColumnRenamed("train", "held_out")


@query("op2_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"), runs=True)
    return done.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query("op3_decontamination", oracles.DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hit.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op4_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_copies", F.col("component").alias("component_id"), "kept")


@query("op5_embedding_near_duplicates", oracles.VECTORS)
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@query("op6_warc", oracles.WARC)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.record_table(warc.read_chunks(spark, files, with_data=False)).withColumnRenamed("id", "page_id")


@query("op7_license_scan", oracles.LICENSES)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.default_templates(spark))


@query("op8_suffix_array_dedup", oracles.REPEATS)
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


@query("op9_language")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language.fold(F.col("doc_id"), 4, 2)
    profiles = language.fit(docs.where(~held))
    return language.predict(docs.withColumn("held_out", held), profiles, ("doc_id", "held_out"))


@query("op10_mix")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), "n_chars", "mix_block", "mix_slot", "mix_row")


@query("op11_conversation_repair", oracles.CONVERSATIONS)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return turns.report(rows, turns.repair(turns.damage(rows)))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = periodic.repeat_words(F.col("text"), F.col("doc_id"))
    return periodic.summary(periodic.collapse_runs(_table(spark, sf_dir, "documents"), text=text))


@query("op13_exact_dedup", oracles.EXACT)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches: even hashes of the id first, then all others against their snapshot."""
    docs = _table(spark, sf_dir, "documents")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    done = exact.deduplicate([docs.where(early), docs.where(~early)])
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
