"""Packing rows into bins of constant volume.

Best-fit decreasing is sequential, so rows are dealt into shards by a stable hash of their key and each
shard is packed alone: the result does not hang on the number of tasks. A shard's size is bounded by
choosing the shard count from the row count.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import running

SHARD_ROWS = 100_000


def best_fit(items: list[tuple[int, int]], volume: int) -> list[list[tuple[int, int]]]:
    """Bins of (key, size): largest first, ties by key, each into the fullest bin that holds it; an item over the volume
    has a bin of its own."""
    bins: list[list[tuple[int, int]]] = []
    space: list[tuple[int, int]] = []  # (room, bin), sorted
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        k = bisect.bisect_left(space, (size, -1))
        if k < len(space):
            room, b = space.pop(k)
            bins[b].append((key, size))
        else:
            room, b = volume, len(bins)  # less than nothing is left where the item is over the volume
            bins.append([(key, size)])
        bisect.insort(space, (room - size, b))
    return bins


def pack(df: DataFrame, key: str, length: Column, volume: int, shards: int | None = None) -> DataFrame:
    """(shard, pack_id, pos, key, length): every row in one pack of its shard. A row of several lengths (an array)
    counts with their sum."""
    several = df.select(length.alias("n")).schema["n"].dataType.typeName() == "array"
    rows = df.select(F.col(key).cast("long").alias("k"), (F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x) if several else length.cast("long")).alias("n"))
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.conv(F.substring(F.md5(F.col("k").cast("string")), 1, 8), 16, 10).cast("long") % shards)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(list(zip(pdf["k"].tolist(), pdf["n"].tolist(), strict=True)), volume)
        out = [(b, i, k, n) for b, items in enumerate(bins) for i, (k, n) in enumerate(items)]
        return pd.DataFrame(out, columns=["pack_id", "pos", key, "length"]).assign(shard=pdf["shard"].iloc[0])[["shard", "pack_id", "pos", key, "length"]]

    return rows.groupBy("shard").applyInPandas(run, f"shard long, pack_id long, pos long, {key} long, length long")


def concatenated(packed: DataFrame, rows: DataFrame, key: str, ids: str) -> DataFrame:
    """(shard, pack_id, ids, positions): token ids of a pack in order, positions from 0 in each row."""
    joined = packed.join(rows.select(key, ids), key)
    packs = joined.groupBy("shard", "pack_id").agg(F.array_sort(F.collect_list(F.struct("pos", ids))).alias("p"))
    ranges = F.transform("p", lambda x: F.when(F.size(x[ids]) > 0, F.sequence(F.lit(0), F.greatest(F.size(x[ids]) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")))
    return packs.select("shard", "pack_id", F.flatten(F.transform("p", lambda x: x[ids])).alias("ids"), F.flatten(ranges).alias("positions"))


def sequential_fill(df: DataFrame, key: str, length: str, volume: int, order: Column, by: Column) -> DataFrame:
    """(key, shard, sample, start, taken): rows laid end to end in order with one free slot between them and cut into
    samples of `volume`; a row that crosses an edge is cut there and its rest goes. `by` bounds the ordered runs, each of
    which is laid out by many tasks (ordered.running)."""
    rows = df.select(key, length, by.alias("shard"), order.alias("_order"))
    at = running(rows, F.col(length) + 1, [F.col("_order"), F.col(key)], "_at", ["shard"])
    room = volume - F.col("_at") % volume
    return at.select(key, "shard", F.floor(F.col("_at") / volume).alias("sample"), (F.col("_at") % volume).alias("start"), F.least(F.col(length), room).alias("taken"))
