"""load_dataset: references to training and validation frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import normalise as N
from corpusloom.operators import sampling as S
from corpusloom.sources.entries import CATALOGUE
from corpusloom.sources.files import concat, read_file, read_splits
from corpusloom.sources.refs import DatasetRef, Registry, select_subsets

REGISTRY = Registry()
REGISTRY.register_json(CATALOGUE)


def _normalised(df: DataFrame, preprocess, columns: dict[str, str] | None, prune: bool) -> DataFrame:
    df = N.rename(df, columns or {})
    df = N.cast_media(preprocess(df) if preprocess else N.auto(df))
    return N.prune(df, ("solution",)) if prune else df


def load(spark: SparkSession, ref: DatasetRef, registry: Registry = REGISTRY, columns: dict[str, str] | None = None, remove_unused_columns: bool = True) -> DataFrame:
    """One reference: a file, or the subsets and splits of a local folder."""
    meta = registry.lookup(ref)
    path = meta.path if ref.dataset in registry.by_name and meta.path else ref.dataset
    columns = {**meta.columns, **(columns or {})}
    target = DatasetRef(path)
    if target.is_file:
        return _normalised(read_file(spark, path), meta.preprocess, columns, remove_unused_columns)
    frames = []
    for s in select_subsets(ref.subsets, meta):
        folder = path if s.subset == "default" else f"{path}/{s.subset}"
        frames.append(_normalised(read_splits(spark, folder, s.split), s.preprocess, columns, remove_unused_columns))
    return concat(frames)


def load_dataset(
    spark: SparkSession, datasets: str | list[str], *, split_dataset_ratio: float = 0.0, seed: int = 42, shuffle: bool = True, interleave_prob: list[float] | None = None,
    stopping_strategy: str = "first_exhausted", columns: dict[str, str] | None = None, remove_unused_columns: bool = True, strict: bool = False, registry: Registry = REGISTRY,
) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, val) of references such as 'data.jsonl#500': loaded, normalised, checked, sampled, split, mixed, shuffled.

    Rows are told apart by a hash of their content, so sampling repeats on every run. Rows with invalid
    messages raise if strict, else they go.
    """
    trains, vals = [], []
    for text in [datasets] if isinstance(datasets, str) else datasets:
        ref = DatasetRef.parse(text)
        df = load(spark, ref, registry, columns, remove_unused_columns)
        if "messages" in df.columns:
            from corpusloom.functions.messages import valid
            from corpusloom.operators.filters import quarantine

            df = quarantine(df, F.when(~valid(F.col("messages")), F.lit("invalid messages")), strict)[0]
        keyed = df.withColumn("_key", F.md5(F.to_json(F.struct(*df.columns))))
        n = ref.sample
        if split_dataset_ratio == 0:
            trains.append(S.sample(keyed, n, "_key", seed, shuffle) if n is not None else keyed)
            continue
        train, val = S.train_val_split(keyed, split_dataset_ratio, "_key", n, seed)
        vals.append(val)
        if split_dataset_ratio < 1:
            trains.append(train)

    def mix(frames: list[DataFrame]) -> DataFrame | None:
        if not frames:
            return None
        if interleave_prob and len(frames) > 1:
            out = S.interleave(frames, interleave_prob, "_key", seed, stopping_strategy)
            return out.orderBy("mix_order", "mix_source").drop("mix_order", "mix_source", "_key")
        out = concat(frames)
        return (S.shuffled(out, "_key", seed) if shuffle else out).drop("_key")

    return mix(trains), mix(vals)
