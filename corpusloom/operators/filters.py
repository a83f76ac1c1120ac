"""Filters that tell what they drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarantine(df: DataFrame, error: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `_error`); strict: the first bad row raises instead."""
    marked = df.withColumn("_error", error)
    if strict:
        checked = F.when(F.col("_error").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_error")).cast("boolean"))
        return marked.where(checked).drop("_error"), marked.limit(0)
    return marked.where("_error IS NULL").drop("_error"), marked.where("_error IS NOT NULL")


def fits(df: DataFrame, lengths: str, most: int) -> DataFrame:
    return df.where(F.array_max(lengths) <= most)


def without_path_parts(df: DataFrame, path: str, parts: list[str]) -> DataFrame:
    return df.where(~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts])))
