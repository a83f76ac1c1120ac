"""Group-relative statistics of rewards: advantages, filters, weights and policy losses.

All are one window or one partial aggregation over the group key; a group's rows are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.sampling import exact_quantile

EPS, GDPO_EPS, BOUND = 1e-4, 1e-8, 20.0


def sample_std(x: Column, window: W) -> Column:
    """Sample deviation; 0 for a single row."""
    return F.coalesce(F.stddev_samp(x).over(window), F.lit(0.0))


def with_batch_std(df: DataFrame, column: str, name: str) -> DataFrame:
    """The deviation over all rows, aggregated once and joined as a single row."""
    return df.crossJoin(F.broadcast(df.agg(F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias(name))))


def group_advantage(df: DataFrame, group: str, reward: str, estimator: str = "grpo", scale: str = "group") -> DataFrame:
    """df with `advantage`. estimator: grpo, rloo or reinforce_plus_plus; scale: group, batch or none."""
    w = W.partitionBy(group)
    r, k = F.col(reward), F.count(reward).over(w)
    base = r - F.avg(r).over(w)
    if estimator == "rloo":  # the baseline is the mean of the others
        base = F.when(k > 1, base * k / (k - 1)).otherwise(base)
    out = df.withColumn("advantage", base)
    spread = "advantage" if estimator == "reinforce_plus_plus" else reward
    if scale == "group":
        return out.withColumn("advantage", F.col("advantage") / (sample_std(F.col(spread), w) + EPS))
    if scale == "batch":
        return with_batch_std(out, spread, "_std").withColumn("advantage", F.col("advantage") / (F.col("_std") + EPS)).drop("_std")
    return out


def gdpo_advantage(df: DataFrame, group: str, rewards: dict[str, float]) -> DataFrame:
    """Each reward is normalised in its group, the weighted sum over the whole batch."""
    w = W.partitionBy(group)
    parts = [(F.col(r) - F.avg(r).over(w)) / (sample_std(F.col(r), w) + GDPO_EPS) * weight for r, weight in rewards.items()]
    out = df.withColumn("_sum", sum(parts[1:], parts[0]))
    stats = out.agg(F.avg("_sum").alias("_mean"), F.coalesce(F.stddev_samp("_sum"), F.lit(0.0)).alias("_std"))
    return out.crossJoin(F.broadcast(stats)).withColumn("advantage", (F.col("_sum") - F.col("_mean")) / (F.col("_std") + GDPO_EPS)).drop("_sum", "_mean", "_std")


def last_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return newest.select("_row.*")


def request_advantage(df: DataFrame, request: str, group: str, reward: str, order: str, atol: float = 1e-6) -> DataFrame:
    """Advantages among requests (last row each), given back to every row; rows of a request must agree on its reward."""
    per = df.groupBy(request).agg(F.max_by(group, order).alias("_group"), F.max_by(reward, order).alias("_reward"), (F.max(reward) - F.min(reward)).alias("_gap"))
    per = per.withColumn("_reward", F.when(F.col("_gap") <= atol, F.col("_reward")).otherwise(F.raise_error(F.lit("rows of a request differ in reward")).cast("double")))
    return df.join(group_advantage(per, "_group", "_reward").select(request, "advantage"), request)


def positive_spread(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ."""
    return df.withColumn("_std", sample_std(F.col(reward), W.partitionBy(group))).where("_std > 0").drop("_std")


def hard_prompts(df: DataFrame, group: str, reward: str, samples: int, threshold: float) -> DataFrame:
    """Groups with fewer than samples * threshold positive rewards besides one."""
    n = F.count_if(F.col(reward) > 0)
    return df.groupBy(group).agg(n.cast("long").alias("positives")).where(F.col("positives") - 1 < int(samples * threshold))


def quantile_mask(df: DataFrame, column: str, share: float, by: str | None = None) -> DataFrame:
    """df with `keep`: in the top `share` of the column by exact linear quantile; NaN and null are left out."""
    clean = df.withColumn("_x", F.when(~F.isnan(column), F.col(column)))
    cut = exact_quantile(clean, "_x", 1 - share, [by] if by else [], "_cut")
    joined = clean.join(cut, by, "left") if by else clean.join(F.broadcast(cut), how="left")  # without groups the cut is one row
    return joined.withColumn("keep", F.coalesce(F.col("_x") >= F.col("_cut"), F.lit(False))).drop("_x", "_cut")


def off_policy_keep(tokens: DataFrame, sequence: str, old: str, new: str, advantage: str, delta: float, order: str | None = None) -> DataFrame:
    """(sequence, mean_log_ratio, keep): dropped if the mean of old - new exceeds delta and the advantage is negative.

    With `order` a sequence's terms are added in that order, so that means next to delta don't hang on the partitioning."""
    mean = F.avg(F.col(old) - F.col(new))
    if order is not None:
        w = W.partitionBy(sequence).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        tokens = tokens.withColumn("_m", mean.over(w))
        mean = F.first("_m")
    per = tokens.groupBy(sequence).agg(mean.alias("mean_log_ratio"), F.first(advantage).alias("_a"))
    return per.select(sequence, "mean_log_ratio", (~((F.col("mean_log_ratio") > delta) & (F.col("_a") < 0))).alias("keep"))


def importance_weights(tokens: DataFrame, sequence: str, log_ratio: str, mode: str, threshold: float = 2.0) -> DataFrame:
    """tokens with `ratio`, `seq_ratio` (geometric mean) and `weight`; mode: token or sequence, truncate or mask."""
    bounded = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col(log_ratio)))
    out = tokens.withColumn("ratio", F.exp(bounded)).withColumn("seq_ratio", F.exp(F.avg(bounded).over(W.partitionBy(sequence))))
    weight = {
        "token_truncate": F.least(F.col("ratio"), F.lit(threshold)),
        "token_mask": F.when(F.col("ratio") <= threshold, F.col("ratio")).otherwise(0.0),
        "sequence_truncate": F.least(F.col("seq_ratio"), F.lit(threshold)),
        "sequence_mask": F.when(F.col("seq_ratio") <= threshold, F.col("ratio")).otherwise(0.0),
    }[mode]
    return out.withColumn("weight", weight)


def weight_metrics(weighted: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Mean weight, effective sample size and the clipped share of token_truncate weights."""
    bounded = F.greatest(F.lit(1 / threshold), F.least(F.lit(threshold), F.col("weight")))
    sums = weighted.agg(F.avg("weight").alias("is_weight_mean"), F.avg(bounded).alias("_m"), F.avg(bounded * bounded).alias("_q"), F.avg((F.col("ratio") > threshold).cast("double")).alias("clipped_frac"))
    ess = 1 / F.greatest(F.col("_q") / ((F.col("_m") + 1e-8) * (F.col("_m") + 1e-8)), F.lit(1e-10))
    return sums.select("is_weight_mean", ess.alias("ess"), "clipped_frac")


def off_policy_metrics(tokens: DataFrame, sequence: str, new: str, old: str) -> DataFrame:
    """Perplexities, divergences and chi-squared of the training policy (new) against the rollout policy (old)."""
    d = F.col(new) - F.col(old)
    safe = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x))
    per = tokens.groupBy(sequence).agg(F.avg(new).alias("n"), F.avg(old).alias("o"), F.avg(d).alias("d"), F.sum(d).alias("sd"), F.sum(F.exp(d) - d - 1).alias("k3"), F.sum(F.exp(2 * safe(d))).alias("r2"), F.count("*").alias("c"))
    total = F.sum("c")
    return per.agg(
        F.avg(F.exp(-F.col("n"))).alias("training_ppl"), F.avg(-F.col("n")).alias("training_log_ppl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg(-F.col("o")).alias("rollout_log_ppl"),
        (-F.sum("sd") / total).alias("kl"), (F.sum("k3") / total).alias("k3_kl"), F.avg(F.col("o") - F.col("n")).alias("log_ppl_diff"), F.avg(F.abs(F.col("o") - F.col("n"))).alias("log_ppl_abs_diff"),
        F.max(F.col("o") - F.col("n")).alias("log_ppl_diff_max"), F.min(F.col("o") - F.col("n")).alias("log_ppl_diff_min"), F.avg(F.exp(F.col("o") - F.col("n"))).alias("ppl_ratio"),
        (F.sum("r2") / total - 1).alias("chi2_token"), (F.avg(F.exp(2 * safe(F.col("d")))) - 1).alias("chi2_seq"),
    )


def policy_loss(tokens: DataFrame, sequence: str, ratio: str, advantage: str, logp: str, kind: str = "grpo", low: float = 0.2, high: float = 0.2, max_length: int = 512, tau: tuple[float, float] = (1.0, 1.05)) -> DataFrame:
    """One row, `loss`: the forward value of a policy loss with its own normaliser.

    kind: grpo and sapo (mean of sequence means), bnpo, dapo and cispo (over all tokens), dr_grpo (over
    sequences times max_length).
    """
    c, a = F.col(ratio), F.col(advantage)
    if kind == "cispo":
        one = -F.least(c, F.lit(high)) * a * F.col(logp)
    elif kind == "sapo":
        gate = lambda t: 1 / (1 + F.exp(-t * (c - 1)))
        one = -F.when(a > 0, gate(tau[0])).otherwise(gate(tau[1])) * a
    else:
        one = -F.least(c * a, F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), c)) * a)
    per = tokens.withColumn("_l", one).groupBy(sequence).agg(F.avg("_l").alias("m"), F.sum("_l").alias("s"), F.count("*").alias("c"))
    value = {"grpo": F.avg("m"), "sapo": F.avg("m"), "dr_grpo": F.sum("s") / (F.count("*") * max_length)}.get(kind, F.sum("s") / F.greatest(F.sum("c"), F.lit(1)))
    return per.agg(value.alias("loss"))
