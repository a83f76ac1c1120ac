"""Aggregations over logs and score tables. NaN is made null at the boundary, so SQL aggregates skip it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bound
from corpusloom.operators.ordered import with_tie_ranks


def clean(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def mean_metric(df: DataFrame, column: str, by: list[str] | None = None, empty: float = 0.0) -> DataFrame:
    """Mean as `value`; `empty` where nothing was seen."""
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(column), F.lit(empty)).alias("value"))


def infer_stats(log: DataFrame, request: str, order: str, prompt: str, generated: str, seconds: float) -> DataFrame:
    """Totals over the last usage of each distinct request, and rates over `seconds`."""
    per = log.groupBy(request).agg(F.max_by(prompt, order).alias("p"), F.max_by(generated, order).alias("g"))
    return per.agg(F.sum("p").alias("num_prompt_tokens"), F.sum("g").alias("num_generated_tokens"), F.count("*").alias("num_samples"), (F.count("*") / F.lit(seconds)).alias("samples_per_s"), (F.sum("g") / F.lit(seconds)).alias("tokens_per_s"))


def stat_array(df: DataFrame, x: Column, by: list[str] | None = None) -> DataFrame:
    """mean, population std, min, max and size."""
    return df.withColumn("_x", x).groupBy(*(by or [])).agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.count("_x").alias("size"))


def token_accuracy(tokens: DataFrame, sequence: str, position: str, predicted: str, label: str, ignore: int = -100) -> DataFrame:
    """token_acc and seq_acc: each prediction against the next label, ignored labels left out."""
    nxt = F.lead(label).over(W.partitionBy(sequence).orderBy(position))
    hit = tokens.withColumn("_next", nxt).where(F.col("_next").isNotNull() & (F.col("_next") != ignore)).withColumn("_hit", (F.col(predicted) == F.col("_next")).cast("int"))
    per = hit.groupBy(sequence).agg(F.sum("_hit").alias("h"), F.count("*").alias("n"))
    return per.agg((F.sum("h") / F.sum("n")).alias("token_acc"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("seq_acc"))


def pair_correlations(scored: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """pearson_<s> and spearman_<s> of the label against each score; tie-averaged ranks."""
    ranked = with_tie_ranks(scored.select(label, *scores), {label: "_r"} | {s: f"_r_{s}" for s in scores})
    return ranked.agg(*[F.corr(label, s).alias(f"pearson_{s}") for s in scores], *[F.corr("_r", f"_r_{s}").alias(f"spearman_{s}") for s in scores])


def marker_groups(df: DataFrame, marker: Column, order: str, name: str = "grp", by: list[str] | None = None) -> DataFrame:
    """df with a group number that goes up at each marker; 0 before the first. `by` bounds the ordered runs."""
    w = W.partitionBy(*(by or [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(marker.cast("int")).over(w))


def rank_metrics(df: DataFrame, group: list[str], label: str, score: str, order: str) -> DataFrame:
    """mrr and ndcg over groups that hold the positive first and at least one more row."""
    w = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col(order))
    ranked = df.select(*group, label, F.row_number().over(w).alias("r"), F.count("*").over(W.partitionBy(*group)).alias("n")).where("n >= 2").where(F.col(label) == 1)
    return ranked.agg(F.coalesce(F.avg(1 / F.col("r")), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg(1 / F.log2(F.col("r") + 1)), F.lit(0.0)).alias("ndcg"), F.count("*").alias("n_queries"))


def listwise_loss(df: DataFrame, group: list[str], label: str, score: str, temperature: float = 1.0) -> DataFrame:
    """Softmax cross-entropy of the positive, averaged over groups of at least two."""
    s = F.col(score) / temperature
    per = df.groupBy(*group).agg(F.max(s).alias("m"), F.max(F.when(F.col(label) == 1, s)).alias("p"), F.count("*").alias("n"), F.collect_list(s).alias("_s")).where("n >= 2 AND p IS NOT NULL")
    lse = F.col("m") + F.log(F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))
    return per.agg(F.avg(lse - F.col("p")).alias("loss"), F.count("*").alias("n_groups"))


def pointwise_loss(df: DataFrame, label: str, score: str) -> DataFrame:
    """Binary cross-entropy with logits, in its stable form."""
    x, y = F.col(score), F.col(label).cast("double")
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def weighted_rewards(df: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of weighted rewards without those missing."""
    parts = [F.coalesce(clean(F.col(c)) * w, F.lit(0.0)) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def reward_monitor(df: DataFrame, group: str, reward: str, atol: float = 1e-8) -> DataFrame:
    """Mean of group means and of group deviations, and the share of groups without spread."""
    per = df.groupBy(group).agg(F.avg(reward).alias("m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return per.agg(F.avg("m").alias("reward"), F.avg("s").alias("reward_std"), F.avg((F.col("s") <= atol).cast("double")).alias("frac_reward_zero_std"))


def kto_balance(df: DataFrame, label: Column) -> DataFrame:
    """Counts of desirable and undesirable rows and the bounds between which the weights balance them (ratio 1 to 4/3)."""
    n = df.agg(F.greatest(F.count_if(label), F.lit(1)).alias("pos"), F.greatest(F.count_if(~label), F.lit(1)).alias("neg"))
    ratio = lambda a, b, k: F.round(F.col(a) * k / F.col(b), 2)
    return n.select("pos", "neg", ratio("neg", "pos", 1.0).alias("des_weight_low"), ratio("neg", "pos", 1.33).alias("des_weight_high"), F.round(F.col("pos") / F.col("neg") / 1.33, 2).alias("und_weight_low"), ratio("pos", "neg", 1.0).alias("und_weight_high"))


def normalised_scores(df: DataFrame, group: str, score: str, threshold: float | None = None) -> DataFrame:
    """df with `norm` (min-max in the group; a constant group gives min(1, v), or 0) and `above` the threshold."""
    w = W.partitionBy(group)
    low, high, s = F.min(score).over(w), F.max(score).over(w), F.col(score)
    norm = F.when(low == high, F.when(low == 0, 0.0).otherwise(F.least(F.lit(1.0), low))).otherwise((s - low) / (high - low + 1e-5))
    return df.withColumn("norm", norm).withColumn("above", F.lit(True) if threshold is None else s > threshold)


def weighted_mean(df: DataFrame, key: list[str], mean: str, n: str) -> DataFrame:
    """Count-weighted mean; sums are associative, so the same plan runs on streams."""
    return df.groupBy(*key).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("mean"), F.sum(n).alias("count"))


def hashed_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of all n-grams, from those of the words; empty where there are fewer than n. Neighbours are paired
    n - 1 times, so the cost is linear in the words. Give a column or a bound value: it is read several times."""
    count = F.greatest(F.size(hashes) - (n - 1), F.lit(0))
    out = F.slice(hashes, 1, count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(hashes, k + 1, count), lambda g, h: F.xxhash64(g, h))
    return out


def ngram_diversity(df: DataFrame, words: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """distinct_<n>: distinct n-grams over all n-grams of each row, by 64-bit hashes (0 where there are none)."""
    out = df.withColumn("_h", hashed_words(words))
    for n in sizes:
        count = F.greatest(F.size("_h") - (n - 1), F.lit(0))
        out = out.withColumn(f"distinct_{n}", F.coalesce(F.try_divide(F.size(F.array_distinct(gram_hashes(F.col("_h"), n))), count), F.lit(0.0)))
    return out.drop("_h")


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def entropy(p: Column) -> Column:
    """Shannon entropy of a distribution; zero terms count nothing."""
    return -total(F.transform(p, lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)))


def logits_entropy(z: Column) -> Column:
    """Shannon entropy of softmax(z): log-sum-exp less the mean logit, from two running sums about the top."""
    def sums(x: Column) -> Column:
        top = F.array_max(x)
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        return F.aggregate(x, start, lambda a, v: F.struct((a["s"] + F.exp(v - top)).alias("s"), (a["w"] + F.exp(v - top) * (v - top)).alias("w")))

    return bound(bound(z, sums), lambda a: F.log(a["s"]) - a["w"] / a["s"])


def kl(p: Column, q: Column, eps: float = 1e-10) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * F.log((a + eps) / (b + eps))))


def jsd(p: Column, q: Column, eps: float = 1e-10) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl(p, m, eps) + kl(q, m, eps)) / 2


def wasserstein(p: Column, q: Column) -> Column:
    """1-D distance: the sum of absolute differences of the running sums."""
    step = F.aggregate(F.zip_with(p, q, lambda a, b: a - b), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum")))
    return step["sum"]


def generalised_jsd(p: Column, q: Column, beta: float = 0.5, eps: float = 1e-10) -> Column:
    """beta 0: KL(q-target, forward), 1: reverse; between: the mixture."""
    if beta == 0:
        return kl(q, p, eps)
    if beta == 1:
        return kl(p, q, eps)
    m = F.zip_with(p, q, lambda a, b: (1 - beta) * a + beta * b)
    return beta * kl(q, m, eps) + (1 - beta) * kl(p, m, eps)


def warm_cosine(step: Column, warm: int, decay: int, peak: float, final: float) -> Column:
    """Linear warm-up to peak, cosine decay to final."""
    decayed = final + (peak - final) * (1 + F.cos(F.lit(3.141592653589793) * F.least((step - warm) / decay, F.lit(1.0)))) / 2
    return F.when(step < warm, step / warm * peak).otherwise(decayed)


def drain_metrics(log: DataFrame, name: str, value: str) -> DataFrame:
    """One row per metric with its mean; metrics without a value go."""
    return log.groupBy(name).agg(F.avg(clean(F.col(value))).alias("value")).where("value IS NOT NULL")
