"""Sampling, splitting, mixing, selection and set queries; documents are the corpus, source the subset, lang the category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import sampling as smp
from corpusloom.plans.registry import query, r6
from corpusloom.session import table


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


_H = "md5('42|' || doc_id::VARCHAR)"
_R = f"r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY {_H}, doc_id) - 1 AS h, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total FROM documents)"


@query("smp01_sample_tiled", f"WITH {_R}, t AS (SELECT doc_id, total, h, unnest(range(2)) AS t FROM r) SELECT doc_id FROM t UNION ALL SELECT doc_id FROM r WHERE h < (total * 5 // 2) % total")
def _(s, d):
    """2.5 times the rows: two whole copies and half of the rows in hashed order."""
    df = docs(s, d)
    return smp.sample(df, df.count() * 5 // 2, "doc_id").select("doc_id")


@query("smp02_train_val_split", f"WITH {_R} SELECT doc_id, CASE WHEN h < greatest((total * 0.1)::BIGINT, 1) THEN 'val' ELSE 'train' END AS part FROM r")
def _(s, d):
    train, val = smp.train_val_split(docs(s, d), 0.1, "doc_id")
    return train.select("doc_id", F.lit("train").alias("part")).union(val.select("doc_id", F.lit("val")))


@query("smp03_stream_split", f"WITH {_R} SELECT doc_id, CASE WHEN i < 20 THEN 'val' ELSE 'train' END AS part FROM r WHERE i < 100")
def _(s, d):
    train, val = smp.stream_split(docs(s, d), 100, 0.2, "doc_id")
    return train.select("doc_id", F.lit("train").alias("part")).union(val.select("doc_id", F.lit("val")))


@query("smp04_shuffle", f"WITH {_R} SELECT doc_id, h AS place FROM r")
def _(s, d):
    return smp.with_rank(docs(s, d), [smp.hashed(42, "doc_id"), F.col("doc_id")], "place", uniform=True).select("doc_id", "place")


@query("smp05_interleave", """WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 b AS (SELECT *, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.25::DOUBLE WHEN 'fr' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END AS p FROM a), m AS (SELECT *, k / p AS o, n / p AS e FROM b) SELECT doc_id, lang, round(o, 6) AS mix_order FROM m WHERE o <= (SELECT min(e) FROM m) + 1e-9""")
def _(s, d):
    df = docs(s, d).select("doc_id", "lang")
    parts = [df.where(F.col("lang") == x) for x in ("en", "de", "fr", "es")]
    return smp.interleave(parts, [0.5, 0.25, 0.15, 0.1], "doc_id").select("doc_id", "lang", r6("mix_order", "mix_order"))


@query("smp06_concat", "SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "text").unionByName(table(s, d, "benchmark").select("text"), allowMissingColumns=True)


_CAT = "WITH f AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id::VARCHAR), doc_id) AS k FROM documents{}) SELECT doc_id, lang FROM f WHERE k <= {}"


@query("smp07_per_category", _CAT.format(" WHERE n_chars <= 3000", 20))
def _(s, d):
    return smp.per_category(docs(s, d), "lang", 20, "doc_id", fits=F.col("n_chars") <= 3000).select("doc_id", "lang")


@query("flt07_category_filter", _CAT.format("", 30))
def _(s, d):
    """All categories in one pass."""
    return smp.per_category(docs(s, d), "lang", 30, "doc_id").select("doc_id", "lang")


@query("smp08_piece", f"WITH {_R} SELECT doc_id FROM r WHERE i >= 2 * (total // 7) AND i < 3 * (total // 7)")
def _(s, d):
    return smp.piece(docs(s, d), 2, 7, "doc_id").select("doc_id")


@query("smp09_rank_shard", f"WITH {_R} SELECT doc_id, i % 6 AS shard FROM r WHERE i < total // 6 * 6")
def _(s, d):
    return smp.with_shard(docs(s, d), "doc_id", 6).select("doc_id", "shard")


@query("smp10_length_grouped", f"WITH {_R} SELECT doc_id, (h // 50) * 50 + row_number() OVER (PARTITION BY h // 50 ORDER BY n_chars DESC, doc_id) - 1 AS place FROM r")
def _(s, d):
    return smp.length_grouped(docs(s, d), "doc_id", "n_chars", 50).select("doc_id", "place")


@query("smp11_round_up_sampler", f"WITH {_R}, w AS (SELECT doc_id, i FROM r UNION ALL SELECT doc_id, i + total FROM r WHERE i < (6 - total % 6) % 6) SELECT doc_id, i % 6 AS shard FROM w")
def _(s, d):
    return smp.with_shard(docs(s, d), "doc_id", 6, drop_last=False).select("doc_id", "shard")


@query("smp12_linspace_split", f"WITH {_R} SELECT doc_id, (SELECT count(*) FROM range(1, 7) t(k) WHERE i >= (k * total) // 7) AS part FROM r")
def _(s, d):
    return smp.linspace_part(docs(s, d), "doc_id", 7).select("doc_id", "part")


@query("smp13_valid_top_up", f"SELECT doc_id FROM documents WHERE n_chars <= 2000 ORDER BY {_H}, doc_id LIMIT 50")
def _(s, d):
    return smp.valid_top_up(docs(s, d), F.col("n_chars") <= 2000, 50, "doc_id").select("doc_id")


@query("smp14_negative_pad", "WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS n FROM events GROUP BY user_id) SELECT user_id, 4::BIGINT AS n_fixed, array_to_string(n[1:least(4, len(n))], ',') AS kept FROM g")
def _(s, d):
    g = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("n"))
    fixed = g.withColumn("f", smp.fit_negatives(F.col("n"), 4, F.col("user_id")))
    return fixed.select("user_id", F.size("f").cast("long").alias("n_fixed"), F.array_join(F.slice("f", 1, F.least(F.lit(4), F.size("n"))).cast("array<string>"), ",").alias("kept"))


@query("smp15_rerank_samples", """WITH e AS (SELECT user_id, event_id, (event_type = 'purchase')::INT AS label, row_number() OVER (PARTITION BY user_id, (event_type = 'purchase')::INT ORDER BY event_id) AS k FROM events),
 n AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS negatives FROM e WHERE label = 0 AND k <= 3 GROUP BY user_id) SELECT user_id, event_id AS positive, coalesce(negatives, '') AS negatives FROM e LEFT JOIN n USING (user_id) WHERE label = 1 AND k <= 2""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return smp.rerank_samples(e, "user_id", "label", "event_id", 2, 3).select("user_id", "positive", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"))


@query("smp16_even_split", f"WITH {_R} SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS part FROM r")
def _(s, d):
    return smp.even_part(docs(s, d), "doc_id", 7).select("doc_id", "part")


@query("smp17_round_robin", f"WITH {_R} SELECT doc_id, i % 5 AS part FROM r")
def _(s, d):
    return smp.round_robin(docs(s, d), "doc_id", 5).select("doc_id", "part")


@query("smp18_sort_by_request", f"WITH {_R} SELECT doc_id, i AS place FROM r")
def _(s, d):
    return smp.with_rank(docs(s, d), [F.col("doc_id")], "place").select("doc_id", "place").orderBy("doc_id")


@query("top01_prune_smallest", "WITH e AS (SELECT user_id % 12 AS layer, event_id AS expert, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS saliency FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY saliency NULLS LAST, expert) AS k FROM e) SELECT layer, expert, round(saliency, 6) AS saliency FROM r WHERE k <= 20 AND saliency IS NOT NULL")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 12).alias("layer"), F.col("event_id").alias("expert"), F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("saliency"))
    return smp.smallest_per_group(e, "layer", "saliency", "expert", 20).select("layer", "expert", r6("saliency", "saliency"))


@query("top02_super_experts", "WITH e AS (SELECT user_id % 12 AS layer, event_id AS expert, value FROM events), c AS (SELECT greatest(quantile_cont(value, 0.995), max(value) / 10) AS cut, min(layer) + floor(count(DISTINCT layer) * 0.75) AS last FROM e) SELECT layer, expert FROM e, c WHERE value > cut AND layer < last")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 12).alias("layer"), F.col("event_id").alias("expert"), "value")
    return smp.super_rows(e, "value", "layer").select("layer", "expert")


@query("top03_best_of_n", """WITH e AS (SELECT user_id, event_id, value / 500 AS orm, (event_id % 7)::DOUBLE AS prm, event_id % 3 > 0 AS ok FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prm + 10 * orm DESC, event_id DESC) AS b, first_value(event_id) OVER (PARTITION BY user_id ORDER BY prm + 10 * orm, event_id) AS rejected FROM e) SELECT user_id, event_id, rejected FROM r WHERE b <= 3 AND ok AND event_id <> rejected""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("value") / 500).alias("orm"), (F.col("event_id") % 7).cast("double").alias("prm"), (F.col("event_id") % 3 > 0).alias("ok"))
    return smp.best_of_n(e, "user_id", "event_id", "orm", "prm", 3, "ok")


@query("top05_dominant_experts", """WITH e AS (SELECT user_id % 12 AS layer, event_id AS expert, value FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY value DESC, expert) AS k FROM e)
 SELECT layer, expert FROM t ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, value DESC, layer, expert LIMIT 40""")
def _(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 12).alias("layer"), F.col("event_id").alias("expert"), "value")
    return smp.dominant(e, "layer", "value", "expert", 40).select("layer", "expert")


@query("top06_report_sort", r"WITH n AS (SELECT o_orderpriority || '-' || (o_orderkey % 30)::VARCHAR AS name FROM orders GROUP BY 1) SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^(.*?)-?(\d+)$', 1), regexp_extract(name, '(\d+)$', 1)::INT DESC) AS place FROM n")
def _(s, d):
    """Reports by name, then by their numeric suffix, highest first (a report has few rows)."""
    from pyspark.sql import Window as W

    n = table(s, d, "orders").select(F.concat_ws("-", "o_orderpriority", (F.col("o_orderkey") % 30).cast("string")).alias("name")).distinct()
    w = W.orderBy(F.regexp_extract("name", r"^(.*?)-?(\d+)$", 1), F.regexp_extract("name", r"(\d+)$", 1).cast("int").desc())
    return n.withColumn("place", F.row_number().over(w).cast("long"))


@query("set01_union_splits", "SELECT doc_id, 'a' AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    df = docs(s, d)
    return df.where("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("part")).unionByName(df.where("doc_id % 3 = 0").select("doc_id", F.lit("b").alias("part")))


@query("set02_content_hash", "SELECT conv_id, turn, md5(concat_ws('|', role, text)) AS id FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(F.concat_ws("|", "role", "text")).alias("id"))


@query("set03_unique_categories", "SELECT DISTINCT lang, source FROM documents")
def _(s, d):
    return docs(s, d).select("lang", "source").distinct()


@query("set05_multiset_match", """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
 SELECT user_id, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::DOUBLE / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 6) AS score FROM a FULL JOIN b USING (user_id, event_type) GROUP BY user_id""")
def _(s, d):
    """Intersection over union of multisets, per key: one aggregation for both sides."""
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    return e.groupBy("user_id").agg(r6(F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b")), "score"))


@query("set06_completion_log_dedup", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS k FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM r WHERE k = 1")
def _(s, d):
    """The first row of each prompt."""
    c = table(s, d, "conversations").where("role = 'user'")
    return c.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("k")).select("k.conv_id", "k.turn")


@query("set07_prompt_ids", "WITH k AS (SELECT text, min(struct_pack(c := conv_id, t := turn)) AS first FROM conversations WHERE role = 'user' GROUP BY text), n AS (SELECT text, row_number() OVER (ORDER BY first) - 1 AS prompt_id FROM k) SELECT conv_id, turn, prompt_id FROM conversations JOIN n USING (text) WHERE role = 'user'")
def _(s, d):
    """Dense numbers of equal prompts in the order first seen."""
    c = table(s, d, "conversations").where("role = 'user'")
    first = c.groupBy("text").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    return c.join(smp.with_rank(first, [F.col("first.conv_id"), F.col("first.turn")], "prompt_id").drop("first"), "text").select("conv_id", "turn", "prompt_id")


@query("jon02_semi_join_media", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(s, d):
    return docs(s, d).join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("jon01_cache_probe", "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT DISTINCT v.conv_id, coalesce(c.n >= 2, false) AS cached FROM conversations v LEFT JOIN c USING (conv_id)")
def _(s, d):
    """Prompts with a full set of cached choices (2) skip generation."""
    c = table(s, d, "conversations")
    cache = c.where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id").distinct().join(cache, "conv_id", "left").select("conv_id", F.coalesce(F.col("n") >= 2, F.lit(False)).alias("cached"))


@query("jon03_anti_negatives", """WITH p AS (SELECT doc_id, lang, md5('9|' || doc_id::VARCHAR) AS h FROM documents), q AS (SELECT lang AS other, doc_id, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k FROM p)
 SELECT p.doc_id, q.doc_id AS negative FROM p JOIN q ON q.other <> p.lang AND q.k = 1 + p.doc_id % 3""")
def _(s, d):
    """Negatives from a hashed pool of each other category (the pool is small by construction)."""
    df = docs(s, d).select("doc_id", "lang")
    pool = smp.per_category(df, "lang", 3, "doc_id", seed=9)
    from pyspark.sql import Window as W

    pool = pool.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(smp.hashed(9, "doc_id"), "doc_id"))).select(F.col("lang").alias("other"), F.col("doc_id").alias("negative"), "k")
    return df.join(F.broadcast(pool), (F.col("other") != F.col("lang")) & (F.col("k") == 1 + F.col("doc_id") % 3)).select("doc_id", "negative")


@query("jon06_broadcast_advantage", "WITH r AS (SELECT user_id, avg(value) AS a FROM events GROUP BY user_id) SELECT event_id, round(a, 6) AS advantage FROM events JOIN r USING (user_id)")
def _(s, d):
    e = table(s, d, "events")
    return e.join(e.groupBy("user_id").agg(F.avg("value").alias("a")), "user_id").select("event_id", r6("a", "advantage"))


@query("jon07_positional_zip", "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) SELECT vec_id, doc_id FROM a JOIN b USING (i)")
def _(s, d):
    a = smp.with_rank(table(s, d, "embeddings").select("vec_id"), [F.col("vec_id")], "i")
    return a.join(smp.with_rank(docs(s, d).select("doc_id"), [F.col("doc_id")], "i"), "i").select("vec_id", "doc_id")


@query("jon09_request_join", "WITH i AS (SELECT user_id, arg_min(event_id, event_id) AS input FROM events WHERE event_id % 2 = 0 GROUP BY user_id) SELECT o.event_id, i.input FROM events o JOIN i USING (user_id) WHERE o.event_id % 2 = 1")
def _(s, d):
    """Outputs to the first input of their request; a miss is an error."""
    from corpusloom.operators.joins import request_join

    e = table(s, d, "events").select("user_id", "event_id")
    return request_join(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0").withColumnRenamed("event_id", "input"), "user_id", "input").select("event_id", "input")


@query("jon10_response_merge", """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn = l.last AND c.role = 'assistant' THEN 'new ' || c.conv_id ELSE c.text END AS text FROM conversations c JOIN l USING (conv_id)
 UNION ALL SELECT c.conv_id, l.last + 1, 'assistant', 'new ' || c.conv_id FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.last WHERE c.role <> 'assistant'""")
def _(s, d):
    from corpusloom.functions.messages import from_turns, with_response

    m = from_turns(table(s, d, "conversations"), "conv_id", "turn", "role", "text")
    m = m.withColumn("messages", with_response(F.col("messages"), F.concat(F.lit("new "), F.col("conv_id").cast("string"))))
    return m.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))
