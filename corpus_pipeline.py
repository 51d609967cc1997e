"""From raw documents to a training mix: language, lines, near duplicates, benchmark passages, source weights.

``STAGES`` are applied in order, each to all that the one before kept. Every stage but the last returns the columns of
``documents``. Stages accept NULLs in any column, empty and repeated rows; a stage over no documents returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.scratch import materialize
from seqframe.llm import decontaminate, language, lines, mixing, near

#: Least share of agreement with the best language profile. Running text of a learned language scores over 0.35.
MIN_SCORE = 0.25


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters or unlike every profile go."""
    profiles = language.fit(docs)
    told = language.predict(docs, profiles, tuple(docs.columns))
    return told.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*_all(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of two or more lines that stand earlier in the corpus; documents of which nothing is left go."""
    done = lines.dedup_lines(docs, carry=tuple(docs.columns), runs=True).where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates. Of rows repeated with id and text one stays."""
    groups = near.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"))
    groups = materialize(groups.groupBy("_id", "_md5").count())
    md5 = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = docs.withColumn("_is", md5)
    kept = kept.join(groups, (F.col("_is") == F.col("_md5")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not groups.where("count > 1 and _id is not null").isEmpty():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "_is"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*_all(docs))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.contamination(docs, items)
    hit = hit.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    mine = docs.withColumn("_is", F.xxhash64("text"))
    return mine.join(hit, (F.col("_is") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(*_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("mix", mix_sources),
]

#: The stages hash, sample and iterate; SQL cannot say that. Tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
