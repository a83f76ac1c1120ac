"""The stages of corpus_pipeline.py: each takes documents and returns those that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, line_dedup, mixing, ngram_jaccard, quality
from corpusloom.llm.common import broadcast_if_small, materialise
from corpusloom.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores under the threshold go. All labels may be learnt from here."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = quality.free_name(docs, "score")
    return quality.score_column(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of any length go from the texts; documents that had text and keep none go."""
    out = line_dedup.remove_boilerplate(docs.select(*COLUMNS), min_chars=1)
    gone = (F.col("n_removed") > 0) & (F.trim("text") == "")
    out = out.where(~F.coalesce(gone, F.lit(False)))
    return out.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingles linked from 0.8 on, the smallest doc_id stays; a null doc_id stays.

    Where an id has several texts, each text is judged by itself: of a component of texts, the first by the smallest
    doc_id that holds it (and a hash) stays, in the rows of that doc_id."""
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b")
    if not several.limit(1).count():
        found = ngram_jaccard.jaccard_components(docs, width=5, num=80, den=100)
        gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    keyed = docs.withColumn("_text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    texts = keyed.where("doc_id IS NOT NULL").groupBy("_text").agg(F.min("doc_id").alias("least"))
    # Ascending numbers in the order of a global sort stand for the texts.
    texts = materialise(texts.orderBy("least", "_text").select("_text", "least", F.monotonically_increasing_id().alias("number")), "texts")
    one = keyed.join(broadcast_if_small(texts), "_text").dropDuplicates(["_text"]).select(F.col("number").alias("doc_id"), "text")
    found = ngram_jaccard.jaccard_components(one, width=5, num=80, den=100).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("number"), (F.col("doc_id") == F.col("component_id")).alias("stays"))
    judged = materialise(texts.join(found, "number").select("_text", F.col("least").alias("_least"), F.col("stays").alias("_stays")), "judged")
    kept = keyed.join(broadcast_if_small(judged), "_text", "left")
    return kept.where(F.col("_stays").isNull() | F.col("doc_id").isNull() | (F.col("_stays") & (F.col("doc_id") == F.col("_least")))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts overlap a benchmark item go, whatever their ids (none, or one of several texts)."""
    text = F.unhex(F.md5("text"))
    found = decontam.contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.select(F.col("doc_id").alias("_text")).distinct(), "contaminated")
    return docs.withColumn("_text", text).join(broadcast_if_small(gone), "_text", "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training plan of what is left: words taken of each document and its positions, in training order."""
    return mixing.curriculum(docs)
