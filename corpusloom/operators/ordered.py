"""Work along one global order: running sums, ranks with ties and exact selection, without a task that sees all rows.

A sort puts rows in ranges, one a partition, of even size however skewed the keys are; the ranges are written with their numbers
(spark.checkpoint.dir), so that the numbers hold when executors are lost. A running sum is the sum of the ranges before, of
which there are few, plus that of the rows before within the range. Selection narrows a bracket in rounds: quantile
sketches propose it, exact counts confirm it, until what is left fits BOUND rows, which are sorted at last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import scratch_dir

#: Distinct values that selection sorts at the end.
BOUND = 50_000


def in_ranges(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df with its order (_o0, _o1, ...) and the number of its range (_part): a written table, sorted by `by` and order."""
    named = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    path = scratch_dir(df.sparkSession, "ordered")
    named.orderBy(*(by or []), *[f"_o{i}" for i in range(len(order))]).withColumn("_part", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, value: Column, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` (whole numbers) over all rows before, 0 at first; within `by` if given. The order must be total."""
    by = by or []
    table = in_ranges(df.withColumn("_v", value), order, by)
    sums = table.groupBy(*by, "_part").agg(F.sum("_v").alias("_s"))
    if by:
        # Groups within one range need no offset; of the others there are at most as many rows as twice the ranges.
        before = F.sum("_s").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        offsets = sums.withColumn("_before", before).where("_before IS NOT NULL").select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_before")
    else:
        rows, total = [], 0
        for r in sorted(sums.collect(), key=lambda r: r["_part"]):  # a row a range
            rows.append((r["_part"], total))
            total += r["_s"] or 0
        offsets = df.sparkSession.createDataFrame(rows, "_p int, _before long")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    w = W.partitionBy("_part", *by).orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(W.unboundedPreceding, -1)
    own = table.withColumn("_own", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return own.join(F.broadcast(offsets), on, "left").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def tie_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """(column, name): the rank, from 1, of each distinct value among all rows; equal values share their mean rank."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    placed = running(counts, F.col("_n"), [F.col(column)], "_before")
    return placed.select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def with_tie_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a rank (values of `columns`) for each column: joins by value, of which AQE splits hot ones."""
    for k, (column, name) in enumerate(columns.items()):
        ranks = tie_ranks(df, column, name).withColumnRenamed(column, f"_x{k}")
        df = df.join(ranks, F.col(column).eqNullSafe(F.col(f"_x{k}"))).drop(f"_x{k}")
    return df


def select(df: DataFrame, column: str, places: tuple[int, int], bound: int = BOUND) -> tuple[float, float] | None:
    """The values at two places (from 0, ascending, at most one apart) among those that are not null; None if there are not so many."""
    x = F.col(column)
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n <= places[1]:
        return None
    below, inside, margin = 0, n, 0.001
    while inside > bound and low < high:
        # Exact counts of the ends tell at once whether a hot value is the answer.
        left = rows.where(F.col("x").between(low, high))
        share = [max(0.0, (places[0] - below) / inside - margin), min(1.0, (places[1] - below) / inside + margin)]
        a, b = left.agg(F.percentile_approx("x", share, 10_000)).first()[0]
        before, within = left.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
        if below + before <= places[0] and places[1] < below + within and (a, b) != (low, high):
            low, high, below, inside = a, b, below + before, within - before
        elif margin < 1 and (a, b) != (low, high):
            margin *= 8
        else:
            at_low, at_high, next_low, next_high = left.agg(F.count_if(F.col("x") == low), F.count_if(F.col("x") == high), F.min(F.when(F.col("x") > low, F.col("x"))), F.max(F.when(F.col("x") < high, F.col("x")))).first()
            if places[1] < below + at_low:
                return low, low
            if places[0] >= below + inside - at_high:
                return high, high
            if places[0] < below + at_low:
                return low, next_low
            if places[1] >= below + inside - at_high:
                return next_high, high
            low, high, below, inside = next_low, next_high, below + at_low, inside - at_low - at_high
            margin = 0.001
    found, at = [], below
    counts = sorted(rows.where(F.col("x").between(low, high)).groupBy("x").count().collect())  # at most `bound` values
    for value, count in counts:
        found += [value for k in places if at <= k < at + count]
        at += count
    return found[0], found[-1]


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile by linear interpolation; None without values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    k = math.floor(at)
    low, high = select(df, column, (k, min(k + 1, n - 1)))
    return low + (at - k) * (high - low)
