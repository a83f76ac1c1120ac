"""Text overlap metrics, tool prompts, loss-scale maps, remaining mappers, plug-ins and crawled reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions import messages as M
from corpusloom.functions import overlap as O
from corpusloom.functions import text as T
from corpusloom.operators import mappers as P
from corpusloom.plans.layout_queries import _D, digest, rows
from corpusloom.plans.registry import query, r6
from corpusloom.session import table


def _halves(s: SparkSession, d: str) -> DataFrame:
    """Each whole document against its words from the fifth on."""
    w = table(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("a")).where("size(a) >= 5")
    return w.select("doc_id", "a", F.slice("a", 5, F.size("a")).alias("b"))


_H = r"w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\f]+') AS w FROM documents), h AS (SELECT doc_id, w AS a, w[5:] AS b FROM w WHERE len(w) >= 5)"
_G2 = "[array_to_string({0}[i:i + 1], ' ') FOR i IN range(1, len({0}))]"


@query("agg08_rouge_means", f"WITH {_H}, g AS (SELECT list_distinct(a) AS a, list_distinct(b) AS b, list_distinct({_G2.format('a')}) AS a2, list_distinct({_G2.format('b')}) AS b2 FROM h) SELECT round(avg(2.0 * len(list_intersect(a, b)) / (len(a) + len(b))) * 100, 6) AS rouge_1, round(avg(coalesce(2.0 * len(list_intersect(a2, b2)) / nullif(len(a2) + len(b2), 0), 0)) * 100, 6) AS rouge_2 FROM g")
def _(s, d):
    a, b = F.col("a"), F.col("b")
    return _halves(s, d).agg(r6(F.avg(O.rouge_n(a, b, 1)) * 100, "rouge_1"), r6(F.avg(O.rouge_n(a, b, 2)) * 100, "rouge_2"))


@query("agg08_rouge_l_bleu_4")
def _(s, d):
    """Each whole document against its words from the fifth on."""
    x = _halves(s, d).select(O.scores(F.col("a"), F.col("b")).alias("x"))
    return x.agg(r6(F.avg("x.rouge_l") * 100, "rouge_l"), r6(F.avg("x.bleu_4") * 100, "bleu_4"))


@query("txt03_round_assembly", "WITH c AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, count(*) FILTER (role = 'user') AS rounds, bool_or(turn = last AND role = 'user') AS open FROM c GROUP BY conv_id")
def _(s, d):
    """Rounds of a conversation, and whether the last one still waits for its answer."""
    m = M.from_turns(table(s, d, "conversations"), "conv_id", "turn", "role", "text")
    return m.select("conv_id", F.size(F.filter("messages", lambda x: x["role"] == "user")).cast("long").alias("rounds"), (M.last(F.col("messages"))["role"] == "user").alias("open"))


@query("txt06_merge_scales", f"WITH {_D} SELECT doc_id, 2::BIGINT AS n, md5(lang || source) AS first FROM d")
def _(s, d):
    seg = lambda t, w: F.struct(t.alias("text"), F.lit(w).alias("weight"))
    x = T.merge_scales(F.array(seg(F.col("lang"), 1.0), seg(F.col("source"), 1.0), seg(F.lit("z"), 0.0)))
    return rows(s, d).select("doc_id", F.size(x).cast("long").alias("n"), F.md5(x[0]["text"]).alias("first"))


@query("txt09_prefix_fan_out", f"WITH {_D} SELECT doc_id, unnest(['anchor', 'positive', 'negative']) AS role, unnest([t, lang, source]) AS text FROM d")
def _(s, d):
    """One row to the texts that a pair encoder reads."""
    item = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("text"))
    return rows(s, d).select("doc_id", F.explode(F.array(item("anchor", "t"), item("positive", "lang"), item("negative", "source"))).alias("x")).select("doc_id", "x.role", "x.text")


@query("txt10_tool_list", f"WITH {_D} SELECT doc_id, lang AS name FROM d UNION ALL SELECT doc_id, source FROM d")
def _(s, d):
    """Tools wrapped or not, unwrapped alike."""
    r = rows(s, d)
    text = F.concat(F.lit('[{"type":"function","function":{"name":"'), "lang", F.lit('"}},{"name":"'), "source", F.lit('"}]'))
    return r.select("doc_id", F.explode(T.parse_tools(text)).alias("t")).select("doc_id", F.get_json_object("t", "$.name").alias("name"))


_CALLS = {
    "glm4": ("{n}\n{a}", "\\A"), "glm4_5": ("<tool_call>{n}\n{a}</tool_call>", ""), "hunyuan": ("<tool_call>{n}\n```json\n{a}\n```</tool_call>", ""), "qwen3_coder": ("<tool_call><function={n}>{a}</function></tool_call>", ""),
    "seed": ("<seed:tool_call><function={n}>{a}</function></seed:tool_call>", ""), "deepseek": ("<｜tool▁call▁begin｜>{n}<｜tool▁sep｜>{a}<｜tool▁call▁end｜>", ""), "llama3": ('{{"name": "{n}", "parameters": {a}}}', ""), "mistral": ('[TOOL_CALLS][{{"name": "{n}", "arguments": {a}}}]', ""),
}
for _kind, (_form, _) in _CALLS.items():
    def _run(s, d, form=_form, kind=_kind):
        before, after = form.format(n="\x01", a="\x02").split("\x01")
        middle, end = after.split("\x02")
        text = F.concat(F.lit(before), "source", F.lit(middle), F.lit('{"x": "'), "lang", F.lit('"}'), F.lit(end))
        return rows(s, d).select("doc_id", F.explode(T.tool_calls(text, kind)).alias("c")).select("doc_id", "c.name", "c.arguments")

    query(f"txt13_calls_{_kind}", f"WITH {_D} SELECT doc_id, source AS name, '{{\"x\": \"' || lang || '\"}}' AS arguments FROM d".replace("{{", "{").replace("}}", "}"))(_run)


@query("txt14_tool_prompt", f"WITH {_D} SELECT doc_id, 'You can use these tools:' || chr(10) || source || ': ' || lang || chr(10) || 'Use one of [' || source || ']' AS prompt FROM d")
def _(s, d):
    tool = F.concat(F.lit('{"name":"'), "source", F.lit('","description":"'), "lang", F.lit('"}'))
    return rows(s, d).select("doc_id", T.tool_prompt(F.array(tool)).alias("prompt"))


@query("txt16_scale_map", f"WITH {_D} SELECT doc_id, unnest(['x' || lang, 'Action:', source]) AS text, unnest([1.0::DOUBLE, 2.0, 3.0]) AS weight FROM d")
def _(s, d):
    x = T.scale_parts(F.concat(F.lit("x"), "lang", F.lit("Action:"), "source"), {"Action:": (2.0, 3.0)})
    return rows(s, d).select("doc_id", F.explode(x).alias("x")).select("doc_id", "x.text", "x.weight")


@query("txt17_scale_spec", """WITH p AS (SELECT event_id, ['last_round+', 'all+', 'default+', '', 'all', 'last_round'][event_id % 6 + 1] || CASE WHEN event_id % 6 < 4 THEN event_type ELSE '' END AS spec FROM events)
 SELECT event_id, CASE WHEN contains(spec, '+') THEN split_part(spec, '+', 1) WHEN spec IN ('default', 'last_round', 'all') THEN spec ELSE 'default' END AS strategy,
  CASE WHEN contains(spec, '+') THEN split_part(spec, '+', 2) WHEN spec IN ('default', 'last_round', 'all') THEN NULL ELSE spec END AS kind FROM p""")
def _(s, d):
    """Specifications of both parts, of a type alone and of a strategy alone."""
    k = F.col("event_id") % 6
    spec = F.concat(F.get(F.array(*map(F.lit, ("last_round+", "all+", "default+", "", "all", "last_round"))), k.cast("int")), F.when(k < 4, F.col("event_type")).otherwise(""))
    strategy, kind = T.scale_spec(spec)
    return table(s, d, "events").select("event_id", strategy.alias("strategy"), kind.alias("kind"))


@query("txt21_json_or_literal", f"WITH {_D} SELECT doc_id, lang AS a FROM d")
def _(s, d):
    from corpusloom.operators.normalise import literal_json

    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("{'a': '")).otherwise(F.lit('{"a": "')), "lang", F.when(F.col("doc_id") % 2 == 0, F.lit("'}")).otherwise(F.lit('"}')))
    return rows(s, d).select("doc_id", F.get_json_object(literal_json(text), "$.a").alias("a"))


_F = lambda s, d: rows(s, d).where("doc_id % 2 = 0").select(F.concat(F.lit("/m/"), "source", F.lit("-"), F.col("doc_id").cast("string")).alias("path"))
_NAME = "concat(source, '-', doc_id)"


@query("map31_share_gpt4o", f"WITH {_D} SELECT md5('user:' || t) AS m FROM d WHERE doc_id % 2 = 0")
def _(s, d):
    """Rows whose file is in the listing."""
    x = rows(s, d).select(F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"), F.expr(_NAME).alias("image"))
    return digest(P.share_gpt4o(x, "/m", _F(s, d)))


@query("map33_sa1b_dense", f"WITH {_D} SELECT lang AS caption FROM d")
def _(s, d):
    x = P.sa1b_dense(rows(s, d).select(F.concat(F.lit("{'global_caption': '"), "lang", F.lit("'}")).alias("cap_seg")))
    return x.select(x.messages[1]["content"].alias("caption"))


@query("map35_mantis", f"WITH {_D} SELECT md5('user:' || t) AS m FROM d WHERE doc_id % 2 = 0")
def _(s, d):
    """All of a row's images must be there."""
    x = rows(s, d).select(F.col("doc_id").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"), F.array(F.struct(F.expr(_NAME).alias("path"))).alias("images"))
    return digest(P.mantis(x, "/m", _F(s, d)))


@query("map37_pixelprose", f"WITH {_D} SELECT lang AS caption, source AS images FROM d")
def _(s, d):
    x = P.pixelprose(rows(s, d).select(F.concat(F.lit("This image displays: "), "lang").alias("vlm_caption"), F.col("source").alias("url")))
    return x.select(x.messages[1]["content"].alias("caption"), "images")


@query("map40_llava_video", f"WITH {_D} SELECT md5('user:' || t) AS m FROM d WHERE doc_id % 2 = 0")
def _(s, d):
    x = rows(s, d).select(F.array(M.message("user", F.col("t"))).alias("messages"), F.expr(_NAME).alias("videos"))
    return digest(P.llava_video(x, "/m", _F(s, d)))


@query("map42_llava_pretrain", f"WITH {_D} SELECT '/m/' || source || '-' || doc_id AS image FROM d WHERE doc_id % 2 = 0")
def _(s, d):
    x = P.llava_pretrain(rows(s, d).select(F.expr(_NAME).alias("image")), "/m", _F(s, d))
    return x.select(x.images[0].alias("image"))


@query("map44_textcaps", f"WITH {_D} SELECT md5('user:What is the caption of this image?|assistant:' || lang) AS m FROM d")
def _(s, d):
    return digest(P.textcaps(rows(s, d).select(F.array("lang", "source").alias("response"), F.struct(F.lit("p").alias("path")).alias("images"))))


@query("map46_refcoco", f"WITH {_D} SELECT source AS ref, 2.0::DOUBLE AS x FROM d")
def _(s, d):
    """Boxes rounded half to even."""
    x = rows(s, d).select(F.concat(F.lit("coco/train2014/"), F.col("doc_id").cast("string")).alias("image_path"), F.array("source").alias("captions"), F.array(F.lit(2.5), F.lit(1.5)).alias("bbox"))
    x = P.refcoco(x, "/c", {"en": [("q", "r")], "zh": [("问", "答")]})
    return x.select(x.objects["ref"][0].alias("ref"), x.objects["bbox"][0][0].alias("x"))


@query("map47_ocrvqa", f"WITH {_D}, h AS (SELECT *, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT % 3 + 1 AS k FROM d) SELECT ['lang?', 'source?', 'size?'][k] AS question, [lang, source, n_chars::VARCHAR][k] AS answer, count(*) AS n FROM h GROUP BY ALL")
def _(s, d):
    """The picked question keeps its own answer."""
    q, a = F.array(F.lit("lang?"), F.lit("source?"), F.lit("size?")), F.array("lang", "source", F.col("n_chars").cast("string"))
    x = P.ocrvqa(rows(s, d).select("doc_id", q.alias("questions"), a.alias("answers")), "doc_id")
    return x.select(x.messages[0]["content"].alias("question"), x.messages[1]["content"].alias("answer")).groupBy("question", "answer").agg(F.count("*").alias("n"))


@query("udx01_row_function", f"WITH {_D} SELECT doc_id, i::BIGINT AS part FROM d, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 3 > 0")
def _(s, d):
    """A Python row function to none or two rows."""
    f = lambda r: [{"doc_id": r["doc_id"], "part": k} for k in (0, 1)] if r["doc_id"] % 3 else None
    return plugins.map_rows(rows(s, d).select("doc_id"), f, "doc_id long, part long")


@query("udx03_reward_registry", f"""WITH {_D}, c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think>' || t || '</think> <answer>' || lang || '</answer>' WHEN 1 THEN '<think>' || t || '</think>' WHEN 2 THEN '<think>' || t || '</think><answer>' || lang || '</answer>' || source ELSE t END AS c FROM d)
 SELECT doc_id, regexp_full_match(c, '<think>.*?</think>\\s*<answer>.*?</answer>', 's')::INT::DOUBLE AS format FROM c""")
def _(s, d):
    """A reward by name, over completions that meet the format, lack the answer, go on behind it or are plain text."""
    k, think = F.col("doc_id") % 4, F.concat(F.lit("<think>"), "t", F.lit("</think>"))
    answer = F.concat(F.lit("<answer>"), "lang", F.lit("</answer>"))
    c = F.when(k == 0, F.concat(think, F.lit(" "), answer)).when(k == 1, think).when(k == 2, F.concat(think, answer, F.col("source"))).otherwise(F.col("t"))
    return rows(s, d).select("doc_id", plugins.REWARDS["format"](c).alias("format"))


@query("udx06_metric_registry", "SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def _(s, d):
    return plugins.METRICS["mean"](table(s, d, "events"), "value", ["event_type"]).select("event_type", r6("value", "value"))


@query("src24_eval_crawl", f"WITH {_D} SELECT lang, round(avg(n_chars), 6)::DOUBLE AS score FROM d GROUP BY lang")
def _(s, d):
    """Reports written as JSON in eval folders and crawled back."""
    from corpusloom.session import scratch_dir

    base = scratch_dir(s, "eval")
    g = rows(s, d).groupBy("lang").agg(r6(F.avg("n_chars"), "score"))
    g.select("lang", "score", F.concat("lang", F.lit("/eval")).alias("folder")).repartition("folder").write.partitionBy("folder").json(base)
    raw = s.read.option("recursiveFileLookup", True).json(base)
    return raw.select("lang", "score")
