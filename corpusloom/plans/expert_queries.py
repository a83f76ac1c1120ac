"""Expert statistics and vectors. Routed tokens are made from the event log (layer user_id % 6, expert event_id % 8, norm
value, gate by user); embeddings stand for expert outputs, their label for the expert, vec_id % 2 for the layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import experts as X
from corpusloom.plans.registry import query, r6
from corpusloom.plans.stats import _COS, _PAIRS, pairs
from corpusloom.session import table

_RT = "t AS (SELECT user_id % 6 AS layer, event_id AS token, event_id % 8 AS expert, value AS norm, 1.0::DOUBLE / (1 + user_id % 4) AS gate FROM events)"


def routed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select((F.col("user_id") % 6).alias("layer"), F.col("event_id").alias("token"), (F.col("event_id") % 8).alias("expert"), F.col("value").alias("norm"), (1 / (1 + F.col("user_id") % 4)).alias("gate"))


@query("agg18_expert_frequency", f"WITH {_RT} SELECT layer, expert, count(*) AS frequency, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY layer), 6) AS probability FROM t GROUP BY layer, expert")
def _(s, d):
    return X.frequencies(routed(s, d), "layer", "expert").select("layer", "expert", "frequency", r6("probability", "probability"))


@query("agg22_expert_probability", f"WITH {_RT}, u AS (SELECT layer, token, expert FROM t UNION SELECT layer, token, (expert + 1 + layer) % 8 FROM t), n AS (SELECT layer, count(DISTINCT token) AS n FROM u GROUP BY layer) SELECT layer, expert, round(count(*)::DOUBLE / any_value(n), 6) AS probability FROM u JOIN n USING (layer) GROUP BY layer, expert")
def _(s, d):
    """Share of a layer's tokens that an expert gets; each token goes to two experts, so shares add up to 2."""
    r = routed(s, d).select("layer", "token", F.explode(F.array("expert", (F.col("expert") + 1 + F.col("layer")) % 8)).alias("expert"))
    tokens = r.groupBy("layer").agg(F.count_distinct("token").alias("n"))
    f = X.frequencies(r, "layer", "expert").join(tokens, "layer")
    return f.select("layer", "expert", r6(F.col("frequency") / F.col("n"), "probability"))


@query("agg18_pairwise_frequency", f"WITH {_RT}, f AS (SELECT layer, expert, count(*) AS f FROM t GROUP BY ALL) SELECT a.layer, a.expert AS i, b.expert AS j, a.f + b.f AS pair_frequency FROM f a JOIN f b USING (layer)")
def _(s, d):
    return X.pairwise_frequency(X.frequencies(routed(s, d), "layer", "expert"), "layer", "expert")


@query("agg19_activation_statistics", f"WITH {_RT} SELECT layer, expert, round(sum(norm), 4) AS ean_sum, round(avg(norm), 6) AS ean_mean, round(sum(norm * gate), 4) AS weighted_ean_sum, round(avg(norm * gate), 6) AS gated_norm_mean, max(norm) AS max_activation, round(sum(gate), 4) AS weighted_frequency FROM t GROUP BY ALL")
def _(s, d):
    a = X.activation_statistics(routed(s, d), "layer", "expert", "norm", "gate")
    return a.select("layer", "expert", F.round("ean_sum", 4).alias("ean_sum"), r6("ean_mean", "ean_mean"), F.round("weighted_ean_sum", 4).alias("weighted_ean_sum"), r6("gated_norm_mean", "gated_norm_mean"), "max_activation", F.round("weighted_frequency", 4).alias("weighted_frequency"))


_EV = "v AS (SELECT vec_id, vec_id % 2 AS layer, label AS expert, embedding::DOUBLE[] AS e FROM embeddings)"


def outputs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 2).alias("layer"), F.col("label").alias("expert"), F.col("embedding").cast("array<double>").alias("e"))


_MEAN = f"{_EV}, x AS (SELECT layer, expert, unnest(e) AS x, unnest(range(len(e))) AS p FROM v), m AS (SELECT layer, expert, p, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT layer, expert, list(m ORDER BY p) AS e FROM m GROUP BY ALL)"


@query("agg21_characteristic_activation", f"WITH {_MEAN} SELECT layer, expert, p::INT AS pos, round(m, 6) AS mean FROM m")
def _(s, d):
    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return c.select("layer", "expert", F.posexplode("mean_vector").alias("pos", "m")).select("layer", "expert", "pos", r6("m", "mean"))


@query("vec07_characteristic_distance", f"WITH {_MEAN} SELECT a.layer, a.expert AS i, b.expert AS j, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS distance FROM c a JOIN c b ON a.layer = b.layer AND a.expert <> b.expert")
def _(s, d):
    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return X.pair_distances(c, "layer", "expert", "mean_vector").select("layer", "i", "j", r6("distance", "distance"))


@query("jon04_expert_cross", f"WITH {_MEAN}, h AS (SELECT a.layer, a.expert AS i, b.expert AS j, round(sqrt(list_sum([(a.e[k] - b.e[k]) * (a.e[k] - b.e[k]) FOR k IN range(1, len(a.e) + 1)])), 6) AS distance FROM c a JOIN c b ON a.layer = b.layer AND a.expert < b.expert) SELECT * FROM h UNION ALL SELECT layer, j, i, distance FROM h")
def _(s, d):
    """Each pair of a layer's experts once, then mirrored."""
    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    half = X.half_cross(c, "layer", "expert").select("layer", "i", "j", r6(V.euclidean(F.col("x.mean_vector"), F.col("y.mean_vector")), "distance"))
    return half.unionByName(half.select("layer", F.col("j").alias("i"), F.col("i").alias("j"), "distance"))


_C = "list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)))"
_VEC = {
    "vec01_angular_distance": (V.angular, f"acos(greatest(-1, least(1, {_C}))) / pi()"),
    "vec02_cosine_distance": (lambda x, y: 1 - V.cosine(x, y), f"1 - {_C}"),
    "vec05_euclidean": (V.euclidean, "sqrt(list_sum([(x[i] - y[i]) * (x[i] - y[i]) FOR i IN range(1, len(x) + 1)]))"),
    "vec08_manhattan": (V.manhattan, "list_sum([abs(x[i] - y[i]) FOR i IN range(1, len(x) + 1)])"),
}
for _name, (_f, _sql) in _VEC.items():
    query(_name, f"WITH {_PAIRS} SELECT id, round({_sql}, 6) AS distance FROM p")(lambda s, d, f=_f: pairs(s, d).select("id", r6(f(F.col("x"), F.col("y")), "distance")))


@query("vec03_centred_cosine", f"WITH {_PAIRS}, c AS (SELECT id, [v - list_avg(x) FOR v IN x] AS x, [v - list_avg(y) FOR v IN y] AS y FROM p) SELECT id, round({_C}, 6) AS similarity FROM c")
def _(s, d):
    return pairs(s, d).select("id", r6(V.centred_cosine(F.col("x"), F.col("y")), "similarity"))


@query("vec04_jsd_of_logits", f"""WITH {_PAIRS}, q AS (SELECT id, [exp(v - list_max(x)) / list_sum([exp(w - list_max(x)) FOR w IN x]) FOR v IN x] AS p, [exp(v - list_max(y)) / list_sum([exp(w - list_max(y)) FOR w IN y]) FOR v IN y] AS q FROM p)
 SELECT id, round(list_sum([p[i] * ln((p[i] + 1e-10) / ((p[i] + q[i]) / 2 + 1e-10)) + q[i] * ln((q[i] + 1e-10) / ((p[i] + q[i]) / 2 + 1e-10)) FOR i IN range(1, 65)]) / 2, 6) AS distance FROM q""")
def _(s, d):
    from corpusloom.operators.aggregates import jsd, softmax

    return pairs(s, d).select("id", softmax(F.col("x")).alias("p"), softmax(F.col("y")).alias("q")).select("id", r6(jsd(F.col("p"), F.col("q")), "distance"))


_TTM = """o AS (SELECT vec_id % 2 AS layer, vec_id // 8 AS token, vec_id // 2 % 4 AS expert, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT * FROM o WHERE expert = token % 3)"""


@query("vec06_token_matrix", f"""WITH {_TTM}, one AS (SELECT r.layer, r.expert AS i, o.expert AS j, sum(acos(greatest(-1, least(1, list_dot_product(r.e, o.e) / (sqrt(list_dot_product(r.e, r.e)) * sqrt(list_dot_product(o.e, o.e)))))) / pi()) AS s FROM r JOIN o ON r.layer = o.layer AND r.token = o.token GROUP BY ALL),
 f AS (SELECT x.layer, x.expert, count(r.token) AS f FROM (SELECT DISTINCT layer, expert FROM o) x LEFT JOIN r ON x.layer = r.layer AND x.expert = r.expert GROUP BY ALL), b AS (SELECT layer, i, j, sum(s) AS s FROM (SELECT * FROM one UNION ALL SELECT layer, j, i, s FROM one) GROUP BY ALL)
 SELECT a.layer, a.expert AS i, c.expert AS j, round(CASE WHEN a.expert = c.expert THEN 0 ELSE coalesce(b.s / nullif(a.f + c.f, 0), 0) END, 6) AS distance FROM f a JOIN f c ON a.layer = c.layer LEFT JOIN b ON b.layer = a.layer AND b.i = a.expert AND b.j = c.expert""")
def _(s, d):
    v = F.col("vec_id")
    o = table(s, d, "embeddings").select((v % 2).alias("layer"), F.floor(v / 8).alias("token"), (F.floor(v / 2) % 4).alias("expert"), F.col("embedding").cast("array<double>").alias("vec"))
    r = o.where(F.col("expert") == F.col("token") % 3).select("layer", "token", "expert")
    return X.token_matrix(r, o, "layer", "token").select("layer", "i", "j", r6("distance", "distance"))


@query("top04_router_top_k", "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, x) AS k FROM e) SELECT vec_id, x::INT AS expert, round(v, 6) AS logit FROM r WHERE k <= 4")
def _(s, d):
    e = F.col("embedding").cast("array<double>")
    t = table(s, d, "embeddings").select("vec_id", F.explode(X.top_k(e, 4)).alias("t"))
    return t.select("vec_id", "t.expert", r6("t.logit", "logit"))


@query("top07_nearest_dominant", f"""WITH {_MEAN}, d AS (SELECT a.layer, a.expert AS i, b.expert AS j, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS dist FROM c a JOIN c b ON a.layer = b.layer AND a.expert <> b.expert)
 SELECT layer, i AS expert, arg_min(j, dist) AS dominant FROM d WHERE j < 3 AND i >= 3 GROUP BY ALL""")
def _(s, d):
    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return X.nearest_dominant(X.pair_distances(c, "layer", "expert", "mean_vector"), c.where("expert < 3").select("layer", "expert"), "layer")


@query("clu08_penalty", f"WITH {_RT}, f AS (SELECT layer, expert, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY layer) AS p FROM t GROUP BY layer, expert) SELECT layer, expert, round(exp(p / 0.1) / sum(exp(p / 0.1)) OVER (PARTITION BY layer), 6) AS penalty, round(p / sum(p) OVER (PARTITION BY layer), 6) AS linear FROM f")
def _(s, d):
    f = X.frequencies(routed(s, d), "layer", "expert")
    out = X.penalty(X.penalty(f, "layer", "probability", 0.1).withColumnRenamed("penalty", "soft"), "layer", "probability")
    return out.select("layer", "expert", r6("soft", "penalty"), r6("penalty", "linear"))


_EL = f"{_EV}, x AS (SELECT layer, expert, vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM v)"


def elements(s: SparkSession, d: str) -> DataFrame:
    return outputs(s, d).select("layer", "expert", "vec_id", F.posexplode("e").alias("pos", "x"))


@query("mrg01_weighted_merge", f"WITH {_EL} SELECT layer, pos::INT AS pos, round(sum(x * (vec_id % 5 + 1)) / (sum(vec_id % 5 + 1) + 1e-9), 6) AS merged FROM x GROUP BY ALL")
def _(s, d):
    return X.weighted_merge(elements(s, d).withColumn("w", F.col("vec_id") % 5 + 1), ["layer"], "pos", "x", "w").select("layer", "pos", r6("merged", "merged"))


@query("mrg02_ties_merge", f"""WITH {_EL}, k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY layer, vec_id ORDER BY abs(x) DESC, pos) <= ceil(count(*) OVER (PARTITION BY layer, vec_id) * 0.4) THEN x ELSE 0 END AS d FROM x), s AS (SELECT *, sign(sum(d) OVER (PARTITION BY layer, pos)) AS s FROM k)
 SELECT layer, pos::INT AS pos, round(coalesce(avg(d) FILTER (sign(d) = s AND d <> 0), 0), 6) AS merged FROM s GROUP BY ALL""")
def _(s, d):
    return X.ties_merge(elements(s, d), ["layer"], "vec_id", "pos", "x", 0.4).select("layer", "pos", r6("merged", "merged"))


@query("mrg03_sign_mask", f"WITH {_EL} SELECT DISTINCT layer, pos::INT AS pos, sign(sum(x) OVER (PARTITION BY layer, pos))::INT AS by_sum, sign(sum(sign(x)) OVER (PARTITION BY layer, pos))::INT AS by_count FROM x")
def _(s, d):
    by_sum, by_count = (X.agreed_signs(elements(s, d), ["layer", "pos"], "x", m, f"by_{m}") for m in ("sum", "count"))
    return by_sum.join(by_count, ["layer", "pos"]).select("layer", "pos", F.col("by_sum").cast("int").alias("by_sum"), F.col("by_count").cast("int").alias("by_count"))


@query("mrg04_sce_merge", f"""WITH {_EL}, q AS (SELECT layer, pos, var_pop(x) AS v FROM x GROUP BY ALL), c AS (SELECT layer, pos FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY v DESC, pos) AS k, count(*) OVER (PARTITION BY layer) AS n FROM q) WHERE k <= ceil(n * 0.5)),
 r AS (SELECT x.* FROM x JOIN c USING (layer, pos)), e AS (SELECT layer, vec_id, sum(x * x) AS e FROM r GROUP BY ALL), w AS (SELECT layer, vec_id, e / sum(e) OVER (PARTITION BY layer) AS w FROM e), j AS (SELECT r.*, w, sign(x) = sign(sum(x) OVER (PARTITION BY r.layer, pos)) AS ok FROM r JOIN w USING (layer, vec_id))
 SELECT layer, pos::INT AS pos, round(coalesce(sum(x * w) FILTER (ok) / nullif(sum(w) FILTER (ok), 0), 0), 6) AS merged FROM j GROUP BY ALL""")
def _(s, d):
    return X.sce_merge(elements(s, d), ["layer"], "vec_id", "pos", "x", 0.5).select("layer", "pos", r6("merged", "merged"))


@query("agg31_router_coupling", """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS x FROM embeddings), c AS (SELECT a.x AS i, b.x AS j, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.x < b.x GROUP BY ALL) SELECT round(avg(abs(r)), 6) AS coupling FROM c""")
def _(s, d):
    from corpusloom.operators.clustering import mean_coupling

    return mean_coupling(table(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e")), "e").select(r6("coupling", "coupling"))


def _distances(s: SparkSession, d: str) -> DataFrame:
    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return X.pair_distances(c, "layer", "expert", "mean_vector")


@query("agg31_effective_rank")
def _(s, d):
    from corpusloom.operators.clustering import effective_rank

    return effective_rank(outputs(s, d), "layer", "e").select("layer", r6("effective_rank", "effective_rank"))


@query("agg32_collapse_metrics")
def _(s, d):
    from corpusloom.operators.clustering import collapse_metrics

    return collapse_metrics(outputs(s, d), "layer", "e").select("layer", *[r6(c, c) for c in ("pc1_share", "pc2_share", "spread", "entropy", "hull_area")])


@query("clu01_agglomerative")
def _(s, d):
    from corpusloom.operators.clustering import agglomerative

    return agglomerative(_distances(s, d), "layer", 4)


@query("clu02_penalised")
def _(s, d):
    from corpusloom.operators.clustering import agglomerative

    f = X.frequencies(outputs(s, d), "layer", "expert").select("layer", F.col("expert").alias("i"), F.col("probability").alias("pi"))
    p = _distances(s, d).join(f, ["layer", "i"]).join(f.select("layer", F.col("i").alias("j"), F.col("pi").alias("pj")), ["layer", "j"])
    return agglomerative(p.select("layer", "i", "j", (F.col("distance") * (1 + F.col("pi") + F.col("pj"))).alias("distance")), "layer", 4)


@query("clu03_size_restricted")
def _(s, d):
    from corpusloom.operators.clustering import agglomerative

    return agglomerative(_distances(s, d), "layer", 4, linkage="two-row mean", max_size=4)


@query("clu04_multi_layer")
def _(s, d):
    from corpusloom.operators.clustering import multi_layer

    return multi_layer(_distances(s, d), "layer", merges=8)


@query("clu05_kmeans")
def _(s, d):
    from corpusloom.operators.clustering import kmeans

    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return kmeans(c, "layer", "expert", "mean_vector", 4)


@query("clu06_kmeans_costs")
def _(s, d):
    from corpusloom.operators.clustering import kmeans_costs

    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return kmeans_costs(c, "layer", "expert", "mean_vector").select("layer", "k", r6("cost", "cost"))


@query("clu07_multi_layer_kmeans")
def _(s, d):
    from corpusloom.operators.clustering import multi_layer_kmeans

    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    return multi_layer_kmeans(c, "layer", "expert", "mean_vector", merges=8)


@query("clu09_cluster_driver")
def _(s, d):
    from corpusloom.operators.clustering import cluster_experts

    c = X.characteristic(outputs(s, d), ["layer", "expert"], "e")
    f = X.frequencies(outputs(s, d), "layer", "expert").select("layer", "expert", "probability")
    return cluster_experts(c.join(f, ["layer", "expert"]), "layer", "expert", "mean_vector", "probability", 4, isolated=[(0, 0)])
