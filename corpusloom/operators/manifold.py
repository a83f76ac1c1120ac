"""Means of directions: the Karcher mean by rounds of tangent sums, and barycentric interpolation on the sphere.

Vectors stay in their rows. A round joins them to the current means (one row a group, written between rounds) and adds up their
tangent vectors by partial aggregation, one sum a coordinate; a group whose tangent sum is shorter than the tolerance keeps
its mean, and the rounds end when all groups do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch_dir


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def _norm(x: Column) -> Column:
    return F.sqrt(_dot(x, x))


def _scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def _plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _over(x: Column | float, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(x if isinstance(x, Column) else F.lit(x), y)


def _vector_sum(x: Column, weight: Column, size: int) -> Column:
    return F.array(*[F.sum(F.get(x, i) * weight) for i in range(size)])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(df: DataFrame, key: str, order: str, vector: str, weight: Column) -> tuple[DataFrame, int]:
    """(g, o, v, w, n: length of v) of the vectors, written once, and their number of coordinates."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("g"), F.col(order).alias("o"), v.alias("v"), weight.cast("double").alias("w")).where("v IS NOT NULL AND w IS NOT NULL")
    rows = _written(rows.withColumn("n", _norm(F.col("v"))), "vectors")
    return rows, rows.agg(F.max(F.size("v"))).first()[0] or 0


def karcher_mean(df: DataFrame, key: str, order: str, vector: str, weight: Column, max_rounds: int = 10, tol: float = 1e-5) -> DataFrame:
    """(key, merged, rounds, residual) of each group of vectors (of one length): the Karcher mean of the directions, times the
    weighted sum of lengths.

    Vectors of length up to tol have no direction. The first guess is the normalised weighted mean, or where that
    vanishes the direction of the first vector by `order`. rounds: steps taken; residual: length of the last tangent sum.
    A group of one vector is that vector, one without directions is zero. Null vectors and weights are left out.
    """
    rows, size = _rows(df, key, order, vector, weight)
    if not size:
        return df.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)['g']}, merged array<double>, rounds int, residual double")
    scales = rows.groupBy("g").agg(F.sum(F.col("w") * F.col("n")).alias("scale"), F.count("*").alias("many"), F.min_by("v", "o").alias("only"))
    some = rows.where(F.col("n") > tol).withColumn("u", _scaled(F.col("v"), _over(1.0, F.col("n"))))
    state = some.groupBy("g").agg(_vector_sum(F.col("u"), F.col("w"), size).alias("m"), F.sum("w").alias("all"), F.min_by("u", "o").alias("first"))
    state = state.withColumn("m", _scaled(F.col("m"), _over(1.0, F.col("all")))).withColumn("l", _norm(F.col("m")))
    mean = F.when(F.col("l") < tol, F.col("first")).otherwise(_scaled(F.col("m"), _over(1.0, F.col("l"))))
    state = _written(state.select("g", "all", mean.alias("mean"), F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("residual"), F.lit(False).alias("done")), "means")
    for _ in range(max_rounds):
        open_ = state.where("NOT done").select("g", "all", "mean")
        if not open_.limit(1).count():
            break
        dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("u"), F.col("mean"))))
        angled = some.join(open_, "g").withColumn("c", dot).withColumn("t", F.acos("c"))
        pull = F.when(F.col("t") < tol, 0.0).otherwise(_over(F.col("w") * F.col("t"), F.col("all") * F.sin("t")))
        sums = angled.withColumn("p", pull).groupBy("g").agg(_vector_sum(F.col("u"), F.col("p"), size).alias("s"), F.sum(F.col("p") * F.col("c")).alias("b"))
        step = state.join(sums, "g", "left").withColumn("tangent", F.zip_with("s", "mean", lambda s, m: s - F.col("b") * m)).withColumn("length", _norm(F.col("tangent")))
        far = ~F.col("done") & (F.col("length") >= tol)
        moved = _plus(_scaled(F.col("mean"), F.cos("length")), _scaled(F.col("tangent"), _over(F.sin("length"), F.col("length"))))
        moved = step.withColumn("moved", moved).withColumn("l", _norm(F.col("moved")))
        state = _written(
            moved.select("g", "all", F.when(far, _scaled(F.col("moved"), _over(1.0, F.col("l")))).otherwise(F.col("mean")).alias("mean"), (F.col("rounds") + far.cast("int")).alias("rounds"), F.coalesce("length", "residual").alias("residual"), (~far).alias("done")),
            "means",
        )
    zero = F.array_repeat(F.lit(0.0), size)
    out = scales.join(state, "g", "left")
    merged = F.when(F.col("many") == 1, F.col("only")).when(F.col("mean").isNull(), zero).otherwise(_scaled(F.col("mean"), F.col("scale")))
    return out.select(F.col("g").alias(key), merged.alias("merged"), F.coalesce("rounds", F.lit(0)).alias("rounds"), "residual")


def multi_slerp(df: DataFrame, key: str, order: str, vector: str, weight: Column, eps: float = 1e-8) -> DataFrame:
    """(key, merged) of each group: vectors go to the tangent space at their weighted mean direction, are averaged there, and go back.

    Weights count by their share. Directions that cancel out have no mean: two vectors are then averaged plainly, more give null.
    """
    rows, size = _rows(df, key, order, vector, weight)
    if not size:
        return df.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)['g']}, merged array<double>")
    rows = rows.withColumn("u", _scaled(F.col("v"), _over(1.0, F.col("n") + eps)))
    per = rows.groupBy("g").agg(
        F.sum("w").alias("all"), F.count("*").alias("many"), F.min_by("v", "o").alias("only"), _vector_sum(F.col("u"), F.col("w"), size).alias("m"), _vector_sum(F.col("v"), F.col("w"), size).alias("plain"), F.sum(F.col("w") * F.col("n")).alias("length")
    )
    per = per.withColumn("m", _scaled(F.col("m"), _over(1.0, F.col("all")))).withColumn("l", _norm(F.col("m")))
    per = _written(per.withColumn("mean", _scaled(F.col("m"), _over(1.0, F.col("l")))).drop("m"), "means")
    dots = rows.join(per.select("g", "mean", "all"), "g").withColumn("c", _dot(F.col("u"), F.col("mean"))).withColumn("s", _over(F.col("w"), F.col("all")))
    sums = dots.groupBy("g").agg(_vector_sum(F.col("u"), F.col("s"), size).alias("t"), F.sum(F.col("s") * F.col("c")).alias("b"))
    out = per.join(sums, "g").withColumn("t", F.zip_with("t", "mean", lambda t, m: t - F.col("b") * m)).withColumn("angle", _norm(F.col("t")) + eps)
    back = _plus(_scaled(F.col("mean"), F.cos("angle")), _scaled(F.col("t"), _over(F.sin("angle"), F.col("angle"))))
    merged = F.when(F.col("many") == 1, F.col("only")).when(F.col("l") >= eps, _scaled(back, _over(F.col("length"), F.col("all")))).when(F.col("many") == 2, _scaled(F.col("plain"), _over(1.0, F.col("all"))))
    return out.select(F.col("g").alias(key), merged.alias("merged"))
