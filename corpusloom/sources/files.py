"""File scans and sinks."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READERS = {"jsonl": "json", "txt": "text"}


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool | None = None) -> DataFrame:
    """A file or folder by its extension. JSON files hold one array unless they are named .jsonl; empty CSV cells stay ''."""
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    kind = READERS.get(ext, ext) or "parquet"
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        # An unquoted empty cell reads as null whatever the options say; CSV has no other null, so all are ''.
        return r.options(header=True, multiLine=True, escape='"').csv(path).fillna("")
    if kind == "json":
        return r.option("multiLine", ext == "json" if array is None else array).json(path)
    if kind == "text":
        return r.text(path)
    return r.format(kind).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file or folder at the path, in whatever store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...], extensions: tuple[str, ...] = ("parquet", "jsonl", "json", "csv", "txt")) -> DataFrame:
    """The splits of a dataset folder in any store: <folder>/<split>.<ext> or <folder>/<split>/, concatenated."""
    frames = []
    for s in splits:
        found = next((p for p in (*(f"{folder}/{s}.{e}" for e in extensions), f"{folder}/{s}") if exists(spark, p)), None)
        if found is None:
            raise FileNotFoundError(f"{folder} has no split {s}")
        frames.append(read_file(spark, found))
    return concat(frames)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """UTF-8 JSON lines, one file for each partition."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", "false").json(path)


def batched(df: DataFrame, key: Column, size: int) -> DataFrame:
    """Rows as dict-of-lists batches of `size` neighbours by key."""
    grouped = df.withColumn("_b", F.floor(key / size))
    return grouped.groupBy("_b").agg(*[F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(c).alias("v")))), lambda s: s["v"]).alias(c) for c in df.columns]).drop("_b")


def unbatched(df: DataFrame, columns: list[str]) -> DataFrame:
    """Batches back to rows; shorter lists are filled with nulls."""
    return df.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")


def cached(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_cached(spark: SparkSession, path: str, key: str, sample: int | None = None, max_length: int | None = None, seed: object = 42) -> DataFrame:
    """A cached dataset with a sample size and a limit on `lengths`."""
    from corpusloom.operators.sampling import sample as draw

    df = spark.read.parquet(path)
    if max_length is not None:
        df = df.where(F.array_max("lengths") <= max_length)
    return df if sample is None else draw(df, sample, key, seed)


def row_slice(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows by id: a pushed-down filter, the counterpart of an offset index."""
    return df.where(F.col(key).isin(ids))


def eval_artifacts(spark: SparkSession, root: str, names: dict[str, str], fields: dict[str, dict[str, str]], folder: str = "eval") -> DataFrame:
    """One wide row of each result folder: `names` gives the JSON file of each kind, `fields` the JSON paths of its columns.

    Missing or broken files leave nulls.
    """
    one = lambda kind: "{" + ",".join(sorted(set(names.values()))) + "}"  # noqa: E731, ARG005
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", one("")).text(root)
    path = F.col("_metadata.file_path")
    base = raw.where(F.array_contains(F.split(path, "/"), folder)).select(F.regexp_extract(path, rf"^(.*/{folder})/", 1).alias("result"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), "value")
    return base.groupBy("result").agg(*[F.max(F.when(F.col("file") == names[kind], F.get_json_object("value", p))).alias(c) for kind, cols in fields.items() for c, p in cols.items()])


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV with a fixed header (a report has few rows)."""
    df.select(*columns).coalesce(1).write.option("header", True).option("emptyValue", "").csv(path)


def preview(df: DataFrame, columns: list[str], n: int, order: list[str], digits: int = 4) -> DataFrame:
    """The first n rows by order, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.orderBy(*order).limit(n).select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else c for c in columns])
