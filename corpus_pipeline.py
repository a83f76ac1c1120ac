"""From raw documents to a training plan: quality, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import stages
from corpusloom.llm.common import materialise
from corpusloom.session import table

STAGES = [
    ("quality classifier", stages.quality_classifier),
    ("line dedup", stages.line_deduplication),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.decontamination),
    ("mixing sources", stages.source_mixing),
]

#: The classifier and the decontamination can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents").select(*stages.COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
