"""Routing statistics of experts from a table of routed tokens, distances between experts, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V


def top_k(logits: Column, k: int) -> Column:
    """The k largest of an array as [(expert, logit)], ties to the lower index."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("expert")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["expert"].alias("expert"), (-p["neg"]).alias("logit")))


def frequencies(routed: DataFrame, layer: str, expert: str) -> DataFrame:
    """frequency and probability of each (layer, expert)."""
    f = routed.groupBy(layer, expert).agg(F.count("*").alias("frequency"))
    return f.withColumn("probability", F.col("frequency") / F.sum("frequency").over(W.partitionBy(layer)))


def pairwise_frequency(freq: DataFrame, layer: str, expert: str, value: str = "frequency") -> DataFrame:
    """f_i + f_j of all pairs of experts of a layer."""
    a, b = freq.select(layer, F.col(expert).alias("i"), F.col(value).alias("fi")), freq.select(layer, F.col(expert).alias("j"), F.col(value).alias("fj"))
    return a.join(b, layer).select(layer, "i", "j", (F.col("fi") + F.col("fj")).alias("pair_frequency"))


def activation_statistics(routed: DataFrame, layer: str, expert: str, norm: str, gate: str) -> DataFrame:
    """Sum and mean of activation norms, gate-weighted sum, mean of norm times gate, and the maximum."""
    x = F.col(norm) * F.col(gate)
    return routed.groupBy(layer, expert).agg(F.sum(norm).alias("ean_sum"), F.avg(norm).alias("ean_mean"), F.sum(x).alias("weighted_ean_sum"), F.avg(x).alias("gated_norm_mean"), F.max(norm).alias("max_activation"), F.sum(gate).alias("weighted_frequency"))


def characteristic(routed: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Mean vector of each key; NaN components count as 0. Sums go by component, so vectors are not gathered."""
    flat = routed.select(*key, F.posexplode(vector).alias("pos", "x"))
    mean = flat.groupBy(*key, "pos").agg(F.avg(F.when(F.isnan("x"), 0.0).otherwise(F.col("x"))).alias("m"))
    return mean.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select(*key, F.transform("v", lambda s: s["m"]).alias("mean_vector"))


def pair_distances(vectors: DataFrame, layer: str, expert: str, vector: str, metric: str = "cosine") -> DataFrame:
    """(layer, i, j, distance) for i <> j of a layer; computed for i < j and mirrored."""
    measure = {"cosine": lambda x, y: 1 - V.cosine(x, y), "euclidean": V.euclidean, "angular": V.angular, "centred": lambda x, y: 1 - V.centred_cosine(x, y)}[metric]
    a, b = vectors.select(layer, F.col(expert).alias("i"), F.col(vector).alias("x")), vectors.select(layer, F.col(expert).alias("j"), F.col(vector).alias("y"))
    half = a.join(b, layer).where("i < j").select(layer, "i", "j", measure(F.col("x"), F.col("y")).alias("distance"))
    return half.union(half.select(layer, "j", "i", "distance"))


def token_matrix(routed: DataFrame, outputs: DataFrame, layer: str, token: str, metric: str = "angular") -> DataFrame:
    """(layer, i, j, distance): distances of the selected expert's output to every expert's on the same token, summed
    over the tokens of i and of j and divided by f_i + f_j; 0 where neither is used and on the diagonal.

    routed (layer, token, expert), outputs (layer, token, expert, vec).
    """
    measure = V.angular if metric == "angular" else (lambda x, y: 1 - V.cosine(x, y))
    sel = routed.join(outputs, [layer, token, "expert"]).select(layer, token, F.col("expert").alias("i"), F.col("vec").alias("x"))
    far = outputs.select(layer, token, F.col("expert").alias("j"), F.col("vec").alias("y"))
    one = sel.join(far, [layer, token]).groupBy(layer, "i", "j").agg(F.sum(measure(F.col("x"), F.col("y"))).alias("s"))
    experts = outputs.select(layer, "expert").distinct()
    f = experts.join(routed.groupBy(layer, "expert").agg(F.count("*").alias("f")), [layer, "expert"], "left").fillna(0, ["f"])
    grid = pairwise_frequency(f, layer, "expert", "f")
    both = one.union(one.select(layer, F.col("j").alias("i"), F.col("i").alias("j"), "s")).groupBy(layer, "i", "j").agg(F.sum("s").alias("s"))
    value = F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.coalesce(F.col("s") / F.nullif("pair_frequency", F.lit(0)), F.lit(0.0)))
    return grid.join(both, [layer, "i", "j"], "left").select(layer, "i", "j", value.alias("distance"))


def nearest_dominant(distances: DataFrame, dominant: DataFrame, layer: str) -> DataFrame:
    """Each other expert's nearest dominant one; dominant (layer, expert)."""
    d = dominant.select(layer, F.col("expert").alias("j"))
    rest = distances.join(d, [layer, "j"]).join(d.select(layer, F.col("j").alias("i")), [layer, "i"], "left_anti")
    return rest.groupBy(layer, "i").agg(F.min(F.struct("distance", "j")).alias("b")).select(layer, F.col("i").alias("expert"), F.col("b.j").alias("dominant"))


def penalty(freq: DataFrame, layer: str, probability: str, temperature: float | None = None) -> DataFrame:
    """freq with `penalty`: p over its sum, or softmax(p / temperature), in each layer."""
    w = W.partitionBy(layer)
    if temperature is None:
        return freq.withColumn("penalty", F.col(probability) / F.sum(probability).over(w))
    e = F.exp((F.col(probability) - F.max(probability).over(w)) / temperature)
    return freq.withColumn("_e", e).withColumn("penalty", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def weighted_merge(elements: DataFrame, key: list[str], pos: str, x: str, weight: str, eps: float = 1e-9) -> DataFrame:
    """Weighted average of every element."""
    return elements.groupBy(*key, pos).agg((F.sum(F.col(x) * F.col(weight)) / (F.sum(weight) + eps)).alias("merged"))


def agreed_signs(elements: DataFrame, by: list[str], x: str, method: str = "sum", name: str = "sign") -> DataFrame:
    """(by..., name): the agreed sign of each element, of the sum of its values or of the count of their signs."""
    return elements.groupBy(*by).agg(F.sign(F.sum(x) if method == "sum" else F.sum(F.sign(F.col(x)))).alias(name))


def ties_merge(elements: DataFrame, key: list[str], model: str, pos: str, delta: str, density: float, weight: float = 1.0) -> DataFrame:
    """Of each model the largest deltas by magnitude; per element the mean of those with the agreed sign."""
    w = W.partitionBy(*key, model)
    rank = F.row_number().over(w.orderBy(F.abs(F.col(delta)).desc(), F.col(pos)))
    kept = elements.withColumn("_d", F.when(rank <= F.ceil(F.count(F.lit(1)).over(w) * density), F.col(delta)).otherwise(0.0))
    kept = kept.join(agreed_signs(kept, [*key, pos], "_d", name="_s"), [*key, pos])
    agree = (F.sign("_d") == F.col("_s")) & (F.col("_d") != 0)
    return kept.groupBy(*key, pos).agg(F.coalesce(F.avg(F.when(agree, F.col("_d"))), F.lit(0.0)).alias("m")).select(*key, pos, (F.col("m") * weight).alias("merged"))


def sce_merge(elements: DataFrame, key: list[str], model: str, pos: str, delta: str, select: float) -> DataFrame:
    """Elements of highest variance over models; models weighted by energy; minority signs erased."""
    var = elements.groupBy(*key, pos).agg(F.var_pop(delta).alias("_v"))
    w = W.partitionBy(*key)
    chosen = var.withColumn("_k", F.row_number().over(w.orderBy(F.col("_v").desc(), F.col(pos)))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_k") <= F.ceil(F.col("_n") * select)).select(*key, pos)
    rows = elements.join(chosen, [*key, pos])
    energy = rows.groupBy(*key, model).agg(F.sum(F.col(delta) * F.col(delta)).alias("_e"))
    energy = energy.withColumn("_w", F.col("_e") / F.sum("_e").over(W.partitionBy(*key)))
    rows = rows.join(energy.select(*key, model, "_w"), [*key, model])
    rows = rows.join(agreed_signs(rows, [*key, pos], delta, name="_s"), [*key, pos]).withColumn("_ok", F.sign(F.col(delta)) == F.col("_s"))
    return rows.groupBy(*key, pos).agg(F.coalesce(F.sum(F.when(F.col("_ok"), F.col(delta) * F.col("_w"))) / F.nullif(F.sum(F.when(F.col("_ok"), F.col("_w"))), F.lit(0.0)), F.lit(0.0)).alias("merged"))


def half_cross(rows: DataFrame, layer: str, expert: str) -> DataFrame:
    """(layer, i, j, x, y) with i < j: the rows of each pair of a layer's experts as structs. A layer has few experts."""
    side = lambda e, v: rows.select(layer, F.col(expert).alias(e), F.struct(*rows.columns).alias(v))
    return side("i", "x").join(side("j", "y"), layer).where("i < j")
