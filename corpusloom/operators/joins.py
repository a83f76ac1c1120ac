"""Joins that the engine needs as operators of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_join(outputs: DataFrame, inputs: DataFrame, key: str, order: str) -> DataFrame:
    """Every output with the first input of its key; an output without one raises."""
    first = inputs.groupBy(key).agg(F.min_by(F.struct(*[c for c in inputs.columns if c != key]), order).alias("_in"))
    joined = outputs.join(first, key, "left")
    found = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("no input for "), F.col(key).cast("string"))).cast(first.schema["_in"].dataType)).otherwise(F.col("_in"))
    return joined.withColumn("_in", found).select(*outputs.columns, "_in.*")


def cache_probe(rows: DataFrame, cache: DataFrame, key: str, full: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached choices, rows still to do): a key is served if the cache holds `full` choices of it."""
    ready = cache.groupBy(key).agg(F.collect_list("choice").alias("choices")).where(F.size("choices") >= full)
    return rows.join(ready, key), rows.join(ready, key, "left_anti")
