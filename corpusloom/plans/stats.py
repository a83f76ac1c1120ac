"""Aggregation and window queries. The event log stands for a reward log: user_id is the prompt group,
value the reward, event_type the channel, event_id the order of rows; log-probabilities are made from value."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import advantage as adv
from corpusloom.operators import aggregates as agg
from corpusloom.plans.registry import query, r6
from corpusloom.session import table


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities by sequence: new, old and an advantage of the sequence. Steps of 0.05 are decimals, as in the SQL: as
    doubles, three of them are 0.15000000000000002."""
    new = -F.col("value") / 100
    step = (F.col("event_id") % 7 - 3) * F.lit(Decimal("0.05"))
    return events(spark, d).select("event_id", F.col("user_id").alias("seq"), new.alias("new"), (new + step.cast("double")).alias("old"), (F.col("user_id") % 5 - 2).cast("double").alias("a"))


_TOK = "t AS (SELECT event_id, user_id AS seq, -value / 100 AS new, -value / 100 + (event_id % 7 - 3) * 0.05 AS old, (user_id % 5 - 2)::DOUBLE AS a FROM events)"
_G = "PARTITION BY user_id"


def _advantage_sql(base: str, spread: str) -> str:
    return f"WITH b AS (SELECT event_id, user_id, value, {base} AS x FROM events) SELECT event_id, round(x{spread}, 9) AS advantage FROM b"


for _name, _est, _scale, _sql in (
    ("win01_group_advantage", "grpo", "group", _advantage_sql(f"value - avg(value) OVER ({_G})", f" / (coalesce(stddev_samp(value) OVER ({_G}), 0) + 1e-4)")),
    ("win01_rloo_advantage", "rloo", "group", _advantage_sql(f"(value - avg(value) OVER ({_G})) * CASE WHEN count(*) OVER ({_G}) > 1 THEN (count(*) OVER ({_G}))::DOUBLE / (count(*) OVER ({_G}) - 1) ELSE 1 END", f" / (coalesce(stddev_samp(value) OVER ({_G}), 0) + 1e-4)")),
    ("win01_reinforce_pp_batch", "reinforce_plus_plus", "batch", _advantage_sql(f"value - avg(value) OVER ({_G})", " / (coalesce(stddev_samp(x) OVER (), 0) + 1e-4)")),
    ("win01_advantage_unscaled", "grpo", "none", _advantage_sql(f"value - avg(value) OVER ({_G})", "")),
):
    query(_name, _sql)(lambda s, d, e=_est, c=_scale: adv.group_advantage(events(s, d), "user_id", "value", e, c).select("event_id", F.round("advantage", 9).alias("advantage")))


@query("win01_gdpo_advantage", f"""WITH e AS (SELECT *, (event_id % 5)::DOUBLE AS fmt FROM events),
 s AS (SELECT event_id, (value - avg(value) OVER ({_G})) / (coalesce(stddev_samp(value) OVER ({_G}), 0) + 1e-8) * 1.0 + (fmt - avg(fmt) OVER ({_G})) / (coalesce(stddev_samp(fmt) OVER ({_G}), 0) + 1e-8) * 0.5 AS s FROM e)
 SELECT event_id, round((s - avg(s) OVER ()) / (coalesce(stddev_samp(s) OVER (), 0) + 1e-8), 6) AS advantage FROM s""")
def _(s, d):
    e = events(s, d).withColumn("fmt", (F.col("event_id") % 5).cast("double"))
    return adv.gdpo_advantage(e, "user_id", {"value": 1.0, "fmt": 0.5}).select("event_id", r6("advantage", "advantage"))


_REQ = "e AS (SELECT event_id, event_id // 3 AS request, (event_id // 3) % 50 AS grp, ((event_id // 3) % 11)::DOUBLE AS reward FROM events)"


@query("win02_request_advantage", f"""WITH {_REQ}, p AS (SELECT request, arg_max(grp, event_id) AS grp, arg_max(reward, event_id) AS reward FROM e GROUP BY request),
 a AS (SELECT request, (reward - avg(reward) OVER (PARTITION BY grp)) / (coalesce(stddev_samp(reward) OVER (PARTITION BY grp), 0) + 1e-4) AS advantage FROM p)
 SELECT event_id, e.request, round(advantage, 6) AS advantage FROM e JOIN a USING (request)""")
def _(s, d):
    q = F.floor(F.col("event_id") / 3)
    e = events(s, d).select("event_id", q.alias("request"), (q % 50).alias("grp"), (q % 11).cast("double").alias("reward"))
    return adv.request_advantage(e, "request", "grp", "reward", "event_id").select("event_id", "request", r6("advantage", "advantage"))


_LAST = "SELECT user_id, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id"


@query("win03_last_per_id", _LAST)
def _(s, d):
    return adv.last_per_id(events(s, d).select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "event_id", r6("value", "value"))


@query("set04_dedup_request_last_wins", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text FROM conversations GROUP BY conv_id")
def _(s, d):
    """Of the rows of a request the last one stays, whole."""
    c = adv.last_per_id(table(s, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    return c.select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("win04_kto_shift", "SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_text FROM conversations")
def _(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    last = F.last("text").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(w), last).alias("kl_text"))


@query("win05_marker_groups", "SELECT user_id, event_id, (sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS grp FROM events")
def _(s, d):
    return agg.marker_groups(events(s, d), F.col("event_type") == "purchase", "event_id", by=["user_id"]).select("user_id", "event_id", "grp")


@query("win06_running_perplexity", "SELECT user_id, event_id, round(exp(avg(value / 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 6) AS ppl FROM events")
def _(s, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return events(s, d).select("user_id", "event_id", r6(F.exp(F.avg(F.col("value") / 100).over(w)), "ppl"))


@query("win07_exponential_smoothing", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
 SELECT a.user_id, a.event_id, round(sum(b.value * 0.1 * pow(0.9, a.k - b.k)) / (1 - pow(0.9, a.k)), 6) AS smooth FROM e a JOIN e b ON a.user_id = b.user_id AND b.k <= a.k GROUP BY a.user_id, a.event_id, a.k""")
def _(s, d):
    """Bias-corrected smoothing at 0.9: a fold over a key's ordered values, every step kept."""
    rows = events(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    step = lambda t, x: F.struct((t["x"] * 0.9 + x["value"] * 0.1).alias("x"), (t["k"] * 0.9).alias("k"), F.concat(t["out"], F.array(F.struct(x["event_id"].alias("event_id"), ((t["x"] * 0.9 + x["value"] * 0.1) / (1 - t["k"] * 0.9)).alias("smooth")))).alias("out"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("k"), F.array().cast("array<struct<event_id:bigint,smooth:double>>").alias("out"))
    return rows.select("user_id", F.explode(F.aggregate("v", zero, step, lambda t: t["out"])).alias("o")).select("user_id", "o.event_id", r6("o.smooth", "smooth"))


@query("win11_early_stop", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS k, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 g AS (SELECT *, max(CASE WHEN best IS NULL OR value > best THEN k ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best_at FROM e)
 SELECT user_id, min(event_id) AS stop_at FROM g WHERE k - best_at >= 3 GROUP BY user_id""")
def _(s, d):
    """The first step with three steps in a row without a new best."""
    w = W.partitionBy("user_id").orderBy("event_id")
    best = F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1))
    e = events(s, d).select("user_id", "event_id", "value", F.row_number().over(w).alias("k"), best.alias("best"))
    at = F.max(F.when(F.col("best").isNull() | (F.col("value") > F.col("best")), F.col("k")).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("at", at).where(F.col("k") - F.col("at") >= 3).groupBy("user_id").agg(F.min("event_id").alias("stop_at"))


@query("win12_pack_positions", "SELECT conv_id, turn, row_number() OVER w - 1 AS pos, (sum(length(text)) OVER w)::BIGINT AS cum_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def _(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cum_len"))


@query("flt09_easy_queries", "SELECT user_id, count(*) FILTER (value > 60) AS positives FROM events GROUP BY user_id HAVING count(*) FILTER (value > 60) - 1 < 24")
def _(s, d):
    return adv.hard_prompts(events(s, d).withColumn("r", F.col("value") - 60), "user_id", "r", 48, 0.5)


@query("flt10_zero_variance_groups", f"WITH e AS (SELECT event_id, user_id, coalesce(stddev_samp(value) OVER ({_G}), 0) AS s FROM events) SELECT event_id, user_id FROM e WHERE s > 0")
def _(s, d):
    return adv.positive_spread(events(s, d), "user_id", "value").select("event_id", "user_id")


@query("flt11_entropy_quantile_mask", "SELECT event_id, value >= quantile_cont(value, 0.8) OVER () AS keep FROM events")
def _(s, d):
    return adv.quantile_mask(events(s, d), "value", 0.2).select("event_id", "keep")


@query("flt12_off_policy_mask", f"WITH {_TOK} SELECT seq, round(avg(old - new), 6) AS mean_log_ratio, NOT (avg(old - new) > 0.01 AND any_value(a) < 0) AS keep FROM t GROUP BY seq")
def _(s, d):
    return adv.off_policy_keep(tokens(s, d), "seq", "old", "new", "a", 0.01, "event_id").select("seq", r6("mean_log_ratio", "mean_log_ratio"), "keep")


@query("agg01_mean_metric", "SELECT event_type, round(coalesce(avg(value), 0), 6) AS value FROM events GROUP BY event_type")
def _(s, d):
    return agg.mean_metric(events(s, d), "value", ["event_type"]).select("event_type", r6("value", "value"))


@query("agg02_infer_stats", """WITH p AS (SELECT user_id, arg_max(event_id % 100, event_id) AS p, arg_max(event_id % 17, event_id) AS g FROM events GROUP BY user_id)
 SELECT sum(p)::BIGINT AS num_prompt_tokens, sum(g)::BIGINT AS num_generated_tokens, count(*) AS num_samples, round(count(*) / 60.0, 6) AS samples_per_s, round(sum(g) / 60.0, 6) AS tokens_per_s FROM p""")
def _(s, d):
    e = events(s, d).select("user_id", "event_id", (F.col("event_id") % 100).alias("p"), (F.col("event_id") % 17).alias("g"))
    return agg.infer_stats(e, "user_id", "event_id", "p", "g", 60.0).select("num_prompt_tokens", "num_generated_tokens", "num_samples", r6("samples_per_s", "samples_per_s"), r6("tokens_per_s", "tokens_per_s"))


def _stats(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, r6("mean", "mean"), r6("std", "std"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "size")


_ST = "round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, count(x) AS size"


@query("agg03_stat_array", f"WITH e AS (SELECT conv_id, sum(length(text)) AS x FROM conversations GROUP BY conv_id) SELECT {_ST} FROM e")
def _(s, d):
    """Inner lists (a conversation's turn lengths) are summed first."""
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("l"))
    return _stats(agg.stat_array(rows, F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)))


@query("agg04_dataset_token_statistics", f"WITH e AS (SELECT source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\f]+')) AS x FROM documents) SELECT source, {_ST} FROM e GROUP BY source")
def _(s, d):
    return _stats(agg.stat_array(table(s, d, "documents"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\f]+"), F.lit(0))), ["source"]), "source")


@query("agg05_length_statistics", f"WITH e AS (SELECT max(length(text)) AS x FROM conversations GROUP BY conv_id) SELECT {_ST} FROM e")
def _(s, d):
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("lengths"))
    return _stats(agg.stat_array(rows, F.array_max("lengths")))


@query("agg06_token_accuracy", """WITH e AS (SELECT user_id, event_id, event_id % 4 AS pred, CASE WHEN event_id % 9 = 0 THEN -100 ELSE event_id % 3 END AS label FROM events),
 n AS (SELECT *, lead(label) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM e), h AS (SELECT user_id, count(*) FILTER (pred = nx) AS h, count(*) AS n FROM n WHERE nx IS NOT NULL AND nx <> -100 GROUP BY user_id)
 SELECT round(sum(h) / sum(n), 6) AS token_acc, round(avg((h = n)::INT), 6) AS seq_acc FROM h""")
def _(s, d):
    e = events(s, d).select("user_id", "event_id", (F.col("event_id") % 4).alias("pred"), F.when(F.col("event_id") % 9 == 0, -100).otherwise(F.col("event_id") % 3).alias("label"))
    return agg.token_accuracy(e, "user_id", "event_id", "pred", "label").select(r6("token_acc", "token_acc"), r6("seq_acc", "seq_acc"))


@query("agg07_exact_match", "SELECT round(avg((quality = toxic)::INT), 6) AS acc FROM labels")
def _(s, d):
    return table(s, d, "labels").agg(r6(F.avg((F.col("quality") == F.col("toxic")).cast("double")), "acc"))


_MK = "m AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp, (event_type = 'purchase')::INT AS label FROM events), g AS (SELECT * FROM m WHERE grp > 0)"


def _groups(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return agg.marker_groups(e, F.col("label") == 1, "event_id", by=["user_id"]).where("grp > 0")


@query("agg11_mrr_ndcg", f"""WITH {_MK}, r AS (SELECT label, row_number() OVER (PARTITION BY user_id, grp ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id, grp) AS n FROM g)
 SELECT round(avg(1.0 / r), 6) AS mrr, round(avg(1.0 / log2(r + 1)), 6) AS ndcg, count(*) AS n_queries FROM r WHERE n >= 2 AND label = 1""")
def _(s, d):
    return agg.rank_metrics(_groups(s, d), ["user_id", "grp"], "label", "value", "event_id").select(r6("mrr", "mrr"), r6("ndcg", "ndcg"), "n_queries")


@query("agg12_channel_loss", "SELECT 'loss_' || event_type AS metric, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS value FROM events GROUP BY event_type")
def _(s, d):
    return events(s, d).groupBy(F.concat(F.lit("loss_"), "event_type").alias("metric")).agg(r6(F.avg(F.when(F.col("event_id") % 10 != 0, F.col("value"))), "value"))


@query("agg13_weighted_reward", "SELECT event_id, round(coalesce(CASE WHEN event_id % 4 > 0 THEN value END * 0.7, 0) + coalesce(CASE WHEN event_id % 3 > 0 THEN event_id % 5 END * 0.3, 0), 6) AS reward FROM events")
def _(s, d):
    nan = F.lit(float("nan"))
    e = events(s, d).select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).otherwise(nan).alias("a"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 5).cast("double")).otherwise(nan).alias("b"))
    return e.select("event_id", r6(agg.weighted_rewards(e, {"a": 0.7, "b": 0.3}), "reward"))


@query("agg14_reward_monitor", "WITH p AS (SELECT avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM events GROUP BY user_id) SELECT round(avg(m), 6) AS reward, round(avg(s), 6) AS reward_std, round(avg((s <= 1e-8)::INT), 6) AS frac_reward_zero_std FROM p")
def _(s, d):
    return agg.reward_monitor(events(s, d), "user_id", "value").select(r6("reward", "reward"), r6("reward_std", "reward_std"), r6("frac_reward_zero_std", "frac_reward_zero_std"))


@query("agg15_kto_balance", """WITH n AS (SELECT greatest(count(*) FILTER (quality = 1), 1) AS pos, greatest(count(*) FILTER (quality = 0), 1) AS neg FROM labels)
 SELECT pos, neg, round(neg * 1.0 / pos, 2) AS des_weight_low, round(neg * 1.33::DOUBLE / pos, 2) AS des_weight_high, round(pos / neg / 1.33::DOUBLE, 2) AS und_weight_low, round(pos * 1.0 / neg, 2) AS und_weight_high FROM n""")
def _(s, d):
    return agg.kto_balance(table(s, d, "labels"), F.col("quality") == 1)


@query("agg16_score_normalise", f"""WITH w AS (SELECT event_id, value, min(value) OVER ({_G}) AS lo, max(value) OVER ({_G}) AS hi FROM events)
 SELECT event_id, round(CASE WHEN lo = hi THEN CASE WHEN lo = 0 THEN 0 ELSE least(1, lo) END ELSE (value - lo) / (hi - lo + 1e-5) END, 6) AS norm, value > 30 AS above FROM w""")
def _(s, d):
    return agg.normalised_scores(events(s, d), "user_id", "value", 30).select("event_id", r6("norm", "norm"), "above")


@query("agg17_genrm_average", "SELECT conv_id, round(coalesce(avg(try_cast(nullif(regexp_extract('Reward: ' || (length(text) / 100.0)::DECIMAL(10, 2), 'Reward: ([0-9.]+)', 1), '') AS DOUBLE)) FILTER (role = 'assistant'), 0), 6) AS score FROM conversations GROUP BY conv_id")
def _(s, d):
    """Scores parsed from judge choices (one per assistant turn), averaged; none gives 0."""
    choice = F.concat(F.lit("Reward: "), (F.length("text") / 100).cast("decimal(10,2)").cast("string"))
    parsed = F.expr("try_cast(nullif(regexp_extract(_c, 'Reward: ([0-9.]+)', 1), '') AS double)")
    rows = table(s, d, "conversations").withColumn("_c", choice)
    return rows.groupBy("conv_id").agg(r6(F.coalesce(F.avg(F.when(F.col("role") == "assistant", parsed)), F.lit(0.0)), "score"))


@query("agg20_weighted_running_mean", "SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS mean, sum(user_id % 7 + 1)::BIGINT AS count FROM events GROUP BY event_type")
def _(s, d):
    e = events(s, d).withColumn("n", F.col("user_id") % 7 + 1)
    return agg.weighted_mean(e, ["event_type"], "value", "n").select("event_type", r6("mean", "mean"), "count")


@query("agg23_report_average", """WITH x AS (SELECT user_id, unnest([CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE (event_id % 10)::VARCHAR END, (event_id % 4)::VARCHAR]) AS v FROM events)
 SELECT user_id, round(avg(try_cast(v AS DOUBLE)), 6) AS average FROM x GROUP BY user_id""")
def _(s, d):
    cells = F.array(F.when(F.col("event_id") % 3 == 0, "N/A").otherwise((F.col("event_id") % 10).cast("string")), (F.col("event_id") % 4).cast("string"))
    x = events(s, d).select("user_id", F.explode(cells).alias("v"))
    return x.groupBy("user_id").agg(r6(F.avg(F.expr("try_cast(v AS double)")), "average"))


_DIST = """v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS p, embedding[33:64]::DOUBLE[] AS q FROM embeddings),
 s AS (SELECT vec_id, [exp(x - list_max(p)) / list_sum([exp(y - list_max(p)) FOR y IN p]) FOR x IN p] AS p, [exp(x - list_max(q)) / list_sum([exp(y - list_max(q)) FOR y IN q]) FOR x IN q] AS q FROM v)"""


def _dists(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(s, d, "embeddings").select("vec_id", agg.softmax(F.slice(e, 1, 32)).alias("p"), agg.softmax(F.slice(e, 33, 32)).alias("q"))


_ENT = "WITH e AS (SELECT vec_id, [exp(x) FOR x IN embedding::DOUBLE[]] AS e FROM embeddings), p AS (SELECT vec_id, [x / list_sum(e) FOR x IN e] AS p FROM e) SELECT vec_id, round(-list_sum([x * ln(x) FOR x IN p]), 6) AS entropy FROM p"


@query("agg24_softmax_entropy", _ENT)
def _(s, d):
    e = agg.softmax(F.col("embedding").cast("array<double>"))
    return table(s, d, "embeddings").select("vec_id", r6(agg.entropy(e), "entropy"))


@query("agg38_logits_entropy", "WITH z AS (SELECT vec_id, [8 * x FOR x IN embedding::DOUBLE[]] AS z FROM embeddings), p AS (SELECT vec_id, z, ln(list_sum([exp(x) FOR x IN z])) AS lse FROM z) SELECT vec_id, round(list_sum([exp(x - lse) * (lse - x) FOR x IN z]), 6) AS entropy FROM p")
def _(s, d):
    """From logits, without the distribution in between."""
    z = F.transform(F.col("embedding").cast("array<double>"), lambda x: 8 * x)
    return table(s, d, "embeddings").select("vec_id", r6(agg.logits_entropy(z), "entropy"))


@query("agg25_divergences", f"""WITH {_DIST} SELECT vec_id, round(list_sum([p[i] * ln((p[i] + 1e-10) / (q[i] + 1e-10)) FOR i IN range(1, 33)]), 6) AS kl_forward, round(list_sum([q[i] * ln((q[i] + 1e-10) / (p[i] + 1e-10)) FOR i IN range(1, 33)]), 6) AS kl_reverse,
 round(list_sum([p[i] * ln((p[i] + 1e-10) / ((p[i] + q[i]) / 2 + 1e-10)) + q[i] * ln((q[i] + 1e-10) / ((p[i] + q[i]) / 2 + 1e-10)) FOR i IN range(1, 33)]) / 2, 6) AS jsd,
 round(list_sum([abs(list_sum(p[1:i]) - list_sum(q[1:i])) FOR i IN range(1, 33)]), 6) AS wasserstein FROM s""")
def _(s, d):
    p, q = F.col("p"), F.col("q")
    return _dists(s, d).select("vec_id", r6(agg.kl(p, q), "kl_forward"), r6(agg.kl(q, p), "kl_reverse"), r6(agg.jsd(p, q), "jsd"), r6(agg.wasserstein(p, q), "wasserstein"))


@query("agg26_ngram_diversity", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\f]+') AS w FROM documents)
 SELECT doc_id, """ + ", ".join(f"round(CASE WHEN len(w) >= {n} THEN len(list_distinct([array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]))::DOUBLE / (len(w) - {n - 1}) ELSE 0 END, 6) AS distinct_{n}" for n in (2, 3, 4)) + " FROM w")
def _(s, d):
    out = agg.ngram_diversity(table(s, d, "documents"), F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\f]+"), F.lit(0)))
    return out.select("doc_id", *[r6(f"distinct_{n}", f"distinct_{n}") for n in (2, 3, 4)])


@query("agg27_generalised_jsd", f"""WITH {_DIST}, m AS (SELECT vec_id, p, q, [0.7 * p[i] + 0.3 * q[i] FOR i IN range(1, 33)] AS m FROM s)
 SELECT vec_id, round(0.3 * list_sum([q[i] * ln((q[i] + 1e-10) / (m[i] + 1e-10)) FOR i IN range(1, 33)]) + 0.7 * list_sum([p[i] * ln((p[i] + 1e-10) / (m[i] + 1e-10)) FOR i IN range(1, 33)]), 6) AS loss FROM m WHERE vec_id % 5 > 0""")
def _(s, d):
    """beta 0.3 over unmasked positions (a fifth of the rows are masked)."""
    return _dists(s, d).where("vec_id % 5 > 0").select("vec_id", r6(agg.generalised_jsd(F.col("p"), F.col("q"), 0.3), "loss"))


@query("agg28_off_policy_metrics", f"""WITH {_TOK}, p AS (SELECT seq, avg(new) AS n, avg(old) AS o, avg(new - old) AS d, sum(new - old) AS sd, sum(exp(new - old) - (new - old) - 1) AS k3, sum(exp(2 * (new - old))) AS r2, count(*) AS c FROM t GROUP BY seq)
 SELECT round(avg(exp(-n)), 6) AS training_ppl, round(avg(-n), 6) AS training_log_ppl, round(avg(exp(-o)), 6) AS rollout_ppl, round(avg(-o), 6) AS rollout_log_ppl, round(-sum(sd) / sum(c), 6) AS kl, round(sum(k3) / sum(c), 6) AS k3_kl, round(avg(o - n), 6) AS log_ppl_diff,
 round(avg(abs(o - n)), 6) AS log_ppl_abs_diff, round(max(o - n), 6) AS log_ppl_diff_max, round(min(o - n), 6) AS log_ppl_diff_min, round(avg(exp(o - n)), 6) AS ppl_ratio, round(sum(r2) / sum(c) - 1, 6) AS chi2_token, round(avg(exp(2 * d)) - 1, 6) AS chi2_seq FROM p""")
def _(s, d):
    out = adv.off_policy_metrics(tokens(s, d), "seq", "new", "old")
    return out.select(*[r6(c, c) for c in out.columns])


_IS = f"WITH {_TOK}, r AS (SELECT event_id, seq, exp(old - new) AS ratio, exp(avg(old - new) OVER (PARTITION BY seq)) AS sr FROM t)"
for _mode, _w in (("token_truncate", "least(ratio, 1.1)"), ("token_mask", "CASE WHEN ratio <= 1.1 THEN ratio ELSE 0 END"), ("sequence_truncate", "least(sr, 1.1)"), ("sequence_mask", "CASE WHEN sr <= 1.1 THEN ratio ELSE 0 END")):
    query(f"vec09_is_weights_{_mode}", f"{_IS} SELECT event_id, round({_w}, 6) AS weight FROM r")(
        lambda s, d, m=_mode: adv.importance_weights(tokens(s, d).withColumn("lr", F.col("old") - F.col("new")), "seq", "lr", m, 1.1).select("event_id", r6("weight", "weight"))
    )


@query("agg29_is_metrics", f"""{_IS}, w AS (SELECT ratio, least(ratio, 1.1) AS w, greatest(1 / 1.1, least(1.1, least(ratio, 1.1))) AS b FROM r)
 SELECT round(avg(w), 6) AS is_weight_mean, round(1 / greatest(avg(b * b) / pow(avg(b) + 1e-8, 2), 1e-10), 6) AS ess, round(avg((ratio > 1.1)::INT), 6) AS clipped_frac FROM w""")
def _(s, d):
    out = adv.weight_metrics(adv.importance_weights(tokens(s, d).withColumn("lr", F.col("old") - F.col("new")), "seq", "lr", "token_truncate", 1.1), 1.1)
    return out.select(*[r6(c, c) for c in out.columns])


_PL = f"WITH {_TOK}, r AS (SELECT seq, new, a, exp(new - old) AS c FROM t)"
_CLIP = "-least(c * a, greatest(0.8, least(1.2, c)) * a)"
_SAPO = "-CASE WHEN a > 0 THEN 1 / (1 + exp(-1.0 * (c - 1))) ELSE 1 / (1 + exp(-1.05 * (c - 1))) END * a"
for _kind, _l, _n in (("grpo", _CLIP, "avg(m)"), ("bnpo", _CLIP, "sum(s) / sum(n)"), ("dr_grpo", _CLIP, "sum(s) / (count(*) * 512)"), ("dapo", _CLIP, "sum(s) / sum(n)"), ("cispo", "-least(c, 0.2) * a * new", "sum(s) / sum(n)"), ("sapo", _SAPO, "avg(m)")):
    query(f"agg30_policy_loss_{_kind}", f"{_PL}, p AS (SELECT avg({_l}) AS m, sum({_l}) AS s, count(*) AS n FROM r GROUP BY seq) SELECT round({_n}, 6) AS loss FROM p")(
        lambda s, d, k=_kind: adv.policy_loss(tokens(s, d).withColumn("c", F.exp(F.col("new") - F.col("old"))), "seq", "c", "a", "new", k).select(r6("loss", "loss"))
    )


@query("agg33_run_statistics", "SELECT event_type AS suite, count(*) AS total, count(*) FILTER (value >= 50) AS success, count(*) FILTER (value < 10) AS errors, count(*) FILTER (value >= 10 AND value < 50) AS failures FROM events GROUP BY event_type")
def _(s, d):
    v = F.col("value")
    return events(s, d).groupBy(F.col("event_type").alias("suite")).agg(F.count("*").alias("total"), F.count_if(v >= 50).alias("success"), F.count_if(v < 10).alias("errors"), F.count_if((v >= 10) & (v < 50)).alias("failures"))


@query("agg36_pointwise_loss", "SELECT round(avg(greatest(value / 50 - 1, 0) - (value / 50 - 1) * (event_type = 'purchase')::INT + ln(1 + exp(-abs(value / 50 - 1)))), 6) AS loss FROM events")
def _(s, d):
    return agg.pointwise_loss(events(s, d).select((F.col("value") / 50 - 1).alias("x"), (F.col("event_type") == "purchase").cast("int").alias("y")), "y", "x").select(r6("loss", "loss"))


@query("agg36_listwise_loss", f"""WITH {_MK}, p AS (SELECT max(value / 20) AS m, max(value / 20) FILTER (label = 1) AS p, count(*) AS n, ln(sum(exp(value / 20))) AS lse FROM g GROUP BY user_id, grp)
 SELECT round(avg(lse - p), 6) AS loss, count(*) AS n_groups FROM p WHERE n >= 2 AND p IS NOT NULL""")
def _(s, d):
    return agg.listwise_loss(_groups(s, d), ["user_id", "grp"], "label", "value", 20.0).select(r6("loss", "loss"), "n_groups")


@query("agg37_nan_std", "SELECT event_type, round(stddev_samp(value) FILTER (event_id % 6 > 0), 6) AS std FROM events GROUP BY event_type")
def _(s, d):
    e = events(s, d).withColumn("x", F.when(F.col("event_id") % 6 > 0, F.col("value")).otherwise(F.lit(float("nan"))))
    return e.groupBy("event_type").agg(r6(F.stddev_samp(agg.clean(F.col("x"))), "std"))


@query("agg39_sequence_logprob", f"WITH {_TOK} SELECT seq, round(sum(CASE WHEN event_id % 4 > 0 THEN new ELSE 0 END), 6) AS logp FROM t GROUP BY seq")
def _(s, d):
    return tokens(s, d).groupBy("seq").agg(r6(F.sum(F.when(F.col("event_id") % 4 > 0, F.col("new")).otherwise(0.0)), "logp"))


@query("agg40_mixed_loss", """WITH m AS (SELECT event_id, value, CASE WHEN event_id < 100 THEN event_id / 100.0 * 0.9 ELSE 0.1 + 0.8 * (1 + cos(pi() * least((event_id - 100) / 500.0, 1))) / 2 END AS mu FROM events)
 SELECT event_id, round(mu, 6) AS mu, round((1 - mu) * value + mu * (event_id % 13), 6) AS loss FROM m""")
def _(s, d):
    e = events(s, d).withColumn("mu", agg.warm_cosine(F.col("event_id"), 100, 500, 0.9, 0.1))
    return e.select("event_id", r6("mu", "mu"), r6((1 - F.col("mu")) * F.col("value") + F.col("mu") * (F.col("event_id") % 13), "loss"))


@query("agg41_metric_drain", "SELECT 'train_' || event_type AS metric, round(avg(value) FILTER (user_id % 2 = 0), 6) AS value FROM events GROUP BY event_type HAVING avg(value) FILTER (user_id % 2 = 0) IS NOT NULL")
def _(s, d):
    log = events(s, d).select(F.concat(F.lit("train_"), "event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("value"))
    return agg.drain_metrics(log, "metric", "value").select("metric", r6("value", "value"))


# Pairs of consecutive vectors: even ids with the next one, labelled by equality of their classes.
_PAIRS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS id, a.e AS x, b.e AS y, (a.label = b.label)::INT AS same FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_COS = "list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))"


def pairs(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    a = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("e").alias("x"), F.col("label").alias("la"))
    return a.join(v.select((F.col("vec_id") - 1).alias("id"), F.col("e").alias("y"), F.col("label").alias("lb")), "id").withColumn("same", (F.col("la") == F.col("lb")).cast("int"))


_SC = {"cosine": _COS, "euclidean": "-sqrt(list_sum([(x[i] - y[i]) * (x[i] - y[i]) FOR i IN range(1, len(x) + 1)]))", "manhattan": "-list_sum([abs(x[i] - y[i]) FOR i IN range(1, len(x) + 1)])", "dot_product": "list_dot_product(x, y)"}


@query("agg09_paired_metrics", f"WITH {_PAIRS}, s AS (SELECT round({_COS} * 10) AS label, " + ", ".join(f"{e} AS {n}" for n, e in _SC.items()) + " FROM p), r AS (SELECT *, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS rl, "
    + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2 AS r_{n}" for n in _SC) + " FROM s) SELECT " + ", ".join(f"round(corr(label, {n}), 6) AS pearson_{n}, round(corr(rl, r_{n}), 6) AS spearman_{n}" for n in _SC) + " FROM r")
def _(s, d):
    x, y = F.col("x"), F.col("y")
    rows = pairs(s, d).select(F.round(V.cosine(x, y) * 10).alias("label"), V.cosine(x, y).alias("cosine"), (-V.euclidean(x, y)).alias("euclidean"), (-V.manhattan(x, y)).alias("manhattan"), V.dot(x, y).alias("dot_product"))
    out = agg.pair_correlations(rows, "label", list(_SC))
    return out.select(*[r6(c, c) for c in out.columns])


@query("agg34_pair_losses", f"""WITH {_PAIRS}, s AS (SELECT same, 1 - {_COS} AS dist FROM p), b AS (SELECT max(dist) FILTER (same = 1) AS pmax, avg(dist) FILTER (same = 1) AS pavg, count(*) FILTER (same = 1) AS np, min(dist) FILTER (same = 0) AS nmin, avg(dist) FILTER (same = 0) AS navg, count(*) FILTER (same = 0) AS nn FROM s)
 SELECT round(avg(0.5 * (same * dist * dist + (1 - same) * pow(greatest(0.5 - dist, 0), 2))), 6) AS contrastive, round(avg(pow(1 - dist - same, 2)), 6) AS cosine_mse,
 round(coalesce(sum(dist * dist) FILTER (same = 1 AND dist > CASE WHEN nn > 1 THEN nmin ELSE pavg END), 0) + coalesce(sum(pow(greatest(0.5 - dist, 0), 2)) FILTER (same = 0 AND dist < CASE WHEN np > 1 THEN pmax ELSE navg END), 0), 6) AS online_contrastive FROM s, b""")
def _(s, d):
    p = pairs(s, d).select("same", (1 - V.cosine(F.col("x"), F.col("y"))).alias("dist"))
    out = V.pair_losses(p, "same", "dist", 0.5)
    return out.select(*[r6(c, c) for c in out.columns])


# In-batch negatives: of four ids the first is the anchor, the next its positive, and the two after it hard negatives.
_NCE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT vec_id // 4 AS g, vec_id // 64 AS batch, e FROM v WHERE vec_id % 4 = 0),
 c AS (SELECT vec_id // 4 AS g, vec_id // 64 AS batch, vec_id % 4 AS role, e FROM v WHERE vec_id % 4 > 0),
 s AS (SELECT a.batch, a.g, (a.g = c.g AND c.role = 1) AS pos, list_dot_product(a.e, c.e) AS s FROM a JOIN c ON a.batch = c.batch)"""


def _similarities(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    key = [F.floor(F.col("vec_id") / 4).alias("g"), F.floor(F.col("vec_id") / 64).alias("batch")]
    return V.in_batch_similarity(v.where("vec_id % 4 = 0").select(*key, "e"), v.where("vec_id % 4 > 0").select(*key, (F.col("vec_id") % 4).alias("role"), "e"))


@query("agg10_infonce_metrics", f"WITH {_NCE}, p AS (SELECT g, max(s) FILTER (pos) AS p, max(s) FILTER (NOT pos) AS n FROM s GROUP BY g) SELECT round((SELECT avg(p - n) FROM p), 6) AS margin, round(avg(s) FILTER (pos), 6) AS mean_pos, round(avg(s) FILTER (NOT pos), 6) AS mean_neg FROM s")
def _(s, d):
    out = V.infonce_metrics(_similarities(s, d))
    return out.select(*[r6(c, c) for c in out.columns])


@query("agg35_infonce_loss", f"WITH {_NCE}, p AS (SELECT g, max(s) FILTER (pos) AS p, ln(sum(exp(s / 0.1))) AS lse FROM s GROUP BY g) SELECT round(avg(lse - p / 0.1), 6) AS loss FROM p WHERE p IS NOT NULL")
def _(s, d):
    return V.infonce_loss(_similarities(s, d), 0.1).select(r6("loss", "loss"))


@query("jon05_similarity_matrix", f"WITH {_NCE} SELECT g, cg, role, round(x, 6) AS similarity FROM (SELECT a.g, c.g AS cg, c.role, list_dot_product(a.e, c.e) AS x FROM a JOIN c ON a.batch = c.batch)")
def _(s, d):
    return _similarities(s, d).select("g", "cg", "role", r6("similarity", "similarity"))
