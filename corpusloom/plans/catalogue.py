"""Every query of the engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import expert_queries, extra_queries, io_queries, layout_queries, merge_queries, message_queries, registry, sampling_queries, source_queries, stats  # noqa: F401  the modules enter their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_queries.flagship(spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
