"""Vector expressions over array<double> columns, all inside the JVM, and losses built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def manhattan(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def angular(x: Column, y: Column) -> Column:
    """acos(cosine) / pi, the cosine clamped."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(x, y)))) / math.pi


def centred(x: Column) -> Column:
    mean = total(x) / F.size(x)
    return F.transform(x, lambda v: v - mean)


def centred_cosine(x: Column, y: Column) -> Column:
    return cosine(centred(x), centred(y))


def pair_losses(pairs: DataFrame, same: str, distance: str, margin: float = 0.5) -> DataFrame:
    """Contrastive, cosine-MSE and online-contrastive values over pairs (cosine distance).

    Online: only positives beyond the nearest negative and negatives within the furthest positive
    count (with one or none on the other side, beyond or within the own mean).
    """
    s, d = F.col(same), F.col(distance)
    hinge = F.pow(F.greatest(margin - d, F.lit(0.0)), 2)
    pos, neg = F.when(s == 1, d), F.when(s == 0, d)
    edges = pairs.agg(F.when(F.count(pos) > 1, F.max(pos)).otherwise(F.avg(neg)).alias("_p"), F.when(F.count(neg) > 1, F.min(neg)).otherwise(F.avg(pos)).alias("_n"))
    return pairs.crossJoin(F.broadcast(edges)).agg(
        F.avg(0.5 * (s * d * d + (1 - s) * hinge)).alias("contrastive"),
        F.avg(F.pow(1 - d - s, 2)).alias("cosine_mse"),
        (F.coalesce(F.sum(F.when((s == 1) & (d > F.col("_n")), d * d)), F.lit(0.0)) + F.coalesce(F.sum(F.when((s == 0) & (d < F.col("_p")), hinge)), F.lit(0.0))).alias("online_contrastive"),
    )


def in_batch_similarity(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """(batch, g, cg, role, positive, similarity): anchors (g, batch, e) against all candidates (g, batch, role, e) of
    their batch; role 1 is the positive. A batch is a fixed number of rows, so the join is linear in batches."""
    c = candidates.select("batch", F.col("g").alias("cg"), "role", F.col("e").alias("ce"))
    out = anchors.join(c, "batch")
    return out.select("batch", "g", "cg", "role", ((F.col("g") == F.col("cg")) & (F.col("role") == 1)).alias("positive"), dot(F.col("e"), F.col("ce")).alias("similarity"))


def infonce_metrics(similarities: DataFrame) -> DataFrame:
    """margin (positive less the highest negative, over anchors), mean_pos and mean_neg."""
    s, p = F.col("similarity"), F.col("positive")
    per = similarities.groupBy("g").agg(F.max(F.when(p, s)).alias("p"), F.max(F.when(~p, s)).alias("n"), F.sum(F.when(p, s)).alias("sp"), F.count_if(p).alias("np"), F.sum(F.when(~p, s)).alias("sn"), F.count_if(~p).alias("nn"))
    return per.agg(F.avg(F.col("p") - F.col("n")).alias("margin"), (F.sum("sp") / F.sum("np")).alias("mean_pos"), (F.sum("sn") / F.sum("nn")).alias("mean_neg"))


def infonce_loss(similarities: DataFrame, temperature: float = 0.1, fake_negative_margin: float | None = None) -> DataFrame:
    """Mean over anchors of log-sum-exp of all similarities less the positive's, divided by the temperature.

    With a margin, negatives that exceed the positive by more than it count as fake and are left out.
    """
    top = similarities.groupBy("g").agg(F.max(F.when(F.col("positive"), F.col("similarity"))).alias("_p"), F.max("similarity").alias("_m")).where("_p IS NOT NULL")
    rows = similarities.join(top, "g")
    if fake_negative_margin is not None:
        rows = rows.where(F.col("positive") | (F.col("similarity") <= F.col("_p") + fake_negative_margin))
    per = rows.groupBy("g").agg(F.first("_p").alias("p"), F.first("_m").alias("m"), F.sum(F.exp((F.col("similarity") - F.col("_m")) / temperature)).alias("z"))
    return per.agg(F.avg(F.log("z") + (F.col("m") - F.col("p")) / temperature).alias("loss"))
