"""Means on the sphere, matched units, scalar event files and concurrent rewards over the driver's tables."""

from __future__ import annotations

import asyncio

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import assignment, concurrent, manifold
from corpusloom.plans.registry import query, r6
from corpusloom.session import scratch_dir, table
from corpusloom.sources import scalars

_DIMS = 64
_V = "v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, (vec_id % 5 + 1)::DOUBLE AS w FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v)"
_SUMS = lambda x, w: "[" + ", ".join(f"sum({w} * {x}[{i}])" for i in range(1, _DIMS + 1)) + "]"
_LEN = "sqrt(list_dot_product({0}, {0}))"


def _by_position(df: DataFrame, *more: str) -> DataFrame:
    return df.select("label", F.posexplode("merged").alias("pos", "x"), *more).select("label", "pos", r6("x", "merged"), *more)


@query("mrg05_karcher_mean", f"""WITH RECURSIVE {_V}, x AS (SELECT label, w, [a / n FOR a IN e] AS u FROM n WHERE n > 1e-5),
 al AS (SELECT label, sum(w) AS al FROM x GROUP BY label), sc AS (SELECT label, sum(w * n) AS scale FROM n GROUP BY label),
 m AS (SELECT label, {_SUMS('u', 'w')} AS m FROM x GROUP BY label),
 s AS (SELECT label, 0 AS r, [a / {_LEN.format('m')} FOR a IN m] AS m, false AS done FROM m
  UNION ALL SELECT label, r + (len >= 1e-5)::INT AS r, CASE WHEN len >= 1e-5 THEN [a / {_LEN.format('moved')} FOR a IN moved] ELSE m END AS m, len < 1e-5 AS done
   FROM (SELECT label, r, m, len, [cos(len) * m[i] + sin(len) * t[i] / len FOR i IN range(1, {_DIMS + 1})] AS moved
    FROM (SELECT label, r, m, t, {_LEN.format('t')} AS len FROM (SELECT label, r, m, [su[i] - b * m[i] FOR i IN range(1, {_DIMS + 1})] AS t
     FROM (SELECT label, any_value(r) AS r, any_value(m) AS m, {_SUMS('u', 'c')} AS su, sum(c * d) AS b
      FROM (SELECT label, r, m, u, d, CASE WHEN acos(d) < 1e-5 THEN 0 ELSE w / al * acos(d) / sin(acos(d)) END AS c
       FROM (SELECT s.label, s.r, s.m, x.u, x.w, al.al, greatest(-1, least(1, list_dot_product(x.u, s.m))) AS d FROM s JOIN x ON x.label = s.label JOIN al ON al.label = s.label WHERE NOT s.done AND s.r < 10)) GROUP BY label))))),
 f AS (SELECT label, max(r) AS r, arg_max(m, r * 2 + done::INT) AS m FROM s GROUP BY label)
 SELECT f.label, unnest(range({_DIMS}))::INT AS pos, round(unnest([scale * a FOR a IN m]), 6) AS merged, r::INT AS rounds FROM f JOIN sc USING (label)""")
def _(s, d):
    """The Karcher mean of each label's vectors and the rounds that it took."""
    out = manifold.karcher_mean(table(s, d, "embeddings"), "label", "vec_id", "embedding", F.col("vec_id") % 5 + 1)
    return _by_position(out, "rounds")


@query("mrg05_multi_slerp", f"""WITH {_V}, x AS (SELECT *, [a / (n + 1e-8) FOR a IN e] AS u FROM n), g AS (SELECT label, sum(w) AS al, sum(w * n) / sum(w) AS length, {_SUMS('u', 'w')} AS m FROM x GROUP BY label),
 h AS (SELECT label, al, length, [a / {_LEN.format('m')} FOR a IN m] AS m FROM g), t AS (SELECT x.label, any_value(h.m) AS m, any_value(length) AS length, {_SUMS('u', '(w / al)')} AS su, sum(w / al * list_dot_product(u, h.m)) AS b FROM x JOIN h ON h.label = x.label GROUP BY x.label),
 k AS (SELECT label, m, length, [su[i] - b * m[i] FOR i IN range(1, {_DIMS + 1})] AS t FROM t), a AS (SELECT *, {_LEN.format('t')} + 1e-8 AS angle FROM k)
 SELECT label, unnest(range({_DIMS}))::INT AS pos, round(unnest([length * (m[i] * cos(angle) + t[i] * sin(angle) / angle) FOR i IN range(1, {_DIMS + 1})]), 6) AS merged FROM a""")
def _(s, d):
    return _by_position(manifold.multi_slerp(table(s, d, "embeddings"), "label", "vec_id", "embedding", F.col("vec_id") % 5 + 1))


@query("mrg06_expert_permutation", f"""WITH RECURSIVE p AS (SELECT vec_id % 2 AS layer, vec_id // 2 % 4 AS expert, vec_id // 8 % 8 AS unit, embedding::DOUBLE[] AS e FROM embeddings),
 m AS (SELECT layer, expert, unit, [{', '.join(f'avg(e[{i}])' for i in range(1, _DIMS + 1))}] AS v FROM p GROUP BY ALL),
 c AS (SELECT a.layer, a.expert, a.unit AS i, b.unit AS j, list_sum([abs(a.v[k] - b.v[k]) FOR k IN range(1, {_DIMS + 1})]) AS cost FROM m a JOIN m b ON a.layer = b.layer AND a.expert > 0 AND b.expert = 0),
 dp AS (SELECT DISTINCT layer, expert, 0::BIGINT AS k, 0::BIGINT AS mask, 0.0::DOUBLE AS cost, []::BIGINT[] AS path FROM c
  UNION ALL SELECT layer, expert, k, mask, min(cost) AS cost, arg_min(path, cost) AS path FROM (SELECT dp.layer, dp.expert, dp.k + 1 AS k, dp.mask | (1 << c.j)::BIGINT AS mask, dp.cost + c.cost AS cost, list_append(dp.path, c.j::BIGINT) AS path
   FROM dp JOIN c ON c.layer = dp.layer AND c.expert = dp.expert AND c.i = dp.k AND dp.mask & (1 << c.j)::BIGINT = 0) GROUP BY layer, expert, k, mask)
 SELECT layer, expert, unnest(range(8))::BIGINT AS unit, unnest(path) AS matched, round(cost, 4) AS total FROM dp WHERE k = 8""")
def _(s, d):
    """Units are mean vectors; the units of each expert are matched to those of the first one of its layer."""
    v = F.col("vec_id")
    e = F.col("embedding").cast("array<double>")
    parts = table(s, d, "embeddings").select((v % 2).alias("layer"), (F.floor(v / 2) % 4).alias("expert"), (F.floor(v / 8) % 8).alias("unit"), e.alias("e"))
    units = parts.groupBy("layer", "expert", "unit").agg(F.array(*[F.avg(F.get("e", i)) for i in range(_DIMS)]).alias("v"))
    first = units.where("expert = 0").select("layer", "expert").distinct()
    out = assignment.permute_units(assignment.unit_costs(units, "layer", "expert", "unit", "v", first), "layer", "expert")
    total = out.groupBy("layer", "expert").agg(F.round(F.sum("cost"), 4).alias("total"))
    return out.join(total, ["layer", "expert"]).select("layer", "expert", "unit", "matched", "total")


@query("src22_scalar_events", "SELECT event_type AS tag, event_id AS step, round(value::FLOAT::DOUBLE, 4) AS value, round(epoch(ts), 3) AS wall_time FROM events")
def _(s, d):
    """Event files written from the log by each task, and read back."""
    s.dataSource.register(scalars.ScalarEvents)
    path = scratch_dir(s, "scalars")
    log = table(s, d, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), F.col("value").cast("float").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    log = log.select("tag", "step", "value", (F.col("us") / 1e6).alias("wall_time"), F.lit("").alias("file"))
    log.repartition(4, "tag").write.format("scalars").mode("append").save(path)
    back = s.read.format("scalars").schema("tag string, step long, value float, wall_time double").load(path)
    return back.select("tag", "step", F.round(F.col("value").cast("double"), 4).alias("value"), F.round("wall_time", 3).alias("wall_time"))


async def _scored(row: dict) -> float | None:
    """Stands for a service: waits, answers, fails or hangs by the row."""
    await asyncio.sleep(2.0 if row["event_id"] % 211 == 7 else row["user_id"] % 3 / 1000)
    if row["event_id"] % 97 == 5:
        raise ConnectionError(row["event_id"])
    return None if row["event_type"] == "view" else row["value"] * 2


@query("udx04_concurrent_rewards", "SELECT event_id, CASE WHEN event_id % 211 = 7 OR event_id % 97 = 5 THEN -1 WHEN event_type = 'view' THEN NULL ELSE round(value * 2, 6) END AS reward FROM events")
def _(s, d):
    """Rewards of calls that wait, some of which fail or take too long."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    out = concurrent.concurrent_rewards(e, e.columns, _scored, limit=256, timeout=0.5, failed=-1.0)
    return out.select("event_id", r6("reward", "reward"))
