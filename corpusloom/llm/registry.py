"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import collocations, decontam, embedding_dedup, line_dedup, mixing, ngram_jaccard, quality, repeats, resampling, secrets, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
    "op7_warc": warc.op7_warc,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_repeats": repeats.op12_repeats,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.mixing_sql(),
    "op4_line_dedup": line_dedup.line_dedup_sql(),
    "op6_ngram_jaccard": ngram_jaccard.JACCARD_SQL,
    "op7_warc": warc.WARC_SQL,
    "op8_embedding_dedup": embedding_dedup.EMBEDDING_SQL,
    "op11_collocations": collocations.COLLOCATIONS_SQL,
    "op13_resampling": resampling.RESAMPLING_SQL,
}
