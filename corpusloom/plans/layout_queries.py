"""Normalisers and dataset mappers over rows made from documents (whole texts), compared message by message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import mappers as P
from corpusloom.operators import normalise as N
from corpusloom.plans.registry import query, r6
from corpusloom.session import table


def rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars", F.coalesce("text", F.lit("")).alias("t"))


_D = "d AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS t FROM documents)"


def digest(df: DataFrame, column: str = "messages") -> DataFrame:
    """One row for each row: MD5 of 'role:content' joined by '|'."""
    return df.select(F.md5(F.array_join(F.transform(column, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("m"))


def _sql(expression: str, where: str = "true") -> str:
    return f"WITH {_D} SELECT md5({expression}) AS m FROM d WHERE {where}"


def turn(role: str, text: str) -> str:
    return f"{{'{role}'}}:{text}"


_c = lambda name: F.col(name)
_ft = lambda role, content: F.struct(F.lit(role).alias("from"), content.alias("value"))

#: name: (columns made from rows, the operator, SQL of the joined messages, SQL filter)
CASES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame], str, str]] = {
    "prj01_rename_collision": (lambda r: r.select(r.t.alias("Query"), r.lang.alias("RESPONSE"), r.source.alias("other")), N.responses, "'user:' || t || '|assistant:' || lang", "true"),
    "prj02_two_phase_rename": (lambda r: r.select(r.t.alias("ask"), r.lang.alias("answer")), lambda x: N.responses(x, {"ask": "query"}), "'user:' || t || '|assistant:' || lang", "true"),
    "prj07_auto": (lambda r: r.select(r.t.alias("instruction"), r.source.alias("input"), r.lang.alias("output")), N.auto, "'user:' || t || chr(10) || source || '|assistant:' || lang", "true"),
    "prj08_response_history": (lambda r: r.select(r.t.alias("query"), F.array(r.lang, r.source).alias("response"), F.array(F.array(F.lit("q"), r.lang)).alias("history"), F.when(r.doc_id % 2 == 0, r.source).alias("system")), N.responses, "CASE WHEN doc_id % 2 = 0 THEN 'system:' || source || '|' ELSE '' END || 'user:q|assistant:' || lang || '|user:' || t || '|assistant:' || lang", "true"),
    "prj08_literal_history": (lambda r: r.select(r.t.alias("query"), r.lang.alias("response"), F.concat(F.lit("[['q', '"), r.source, F.lit("']]")).alias("history")), N.responses, "'user:q|assistant:' || source || '|user:' || t || '|assistant:' || lang", "true"),
    "prj09_alpaca": (lambda r: r.select(r.t.alias("instruction"), F.when(r.doc_id % 2 == 0, r.source).otherwise("").alias("input"), r.lang.alias("output")), N.alpaca, "'user:' || t || CASE WHEN doc_id % 2 = 0 THEN chr(10) || source ELSE '' END || '|assistant:' || lang", "true"),
    "prj10_messages": (lambda r: r.select(F.array(_ft("human", r.t), _ft("gpt", r.lang), _ft("function-call", r.source), _ft("observation", r.lang)).alias("conversations"), r.source.alias("system")), N.conversations, "'system:' || source || '|user:' || t || '|assistant:' || lang || '|tool_call:' || source || '|tool_response:' || lang", "true"),
    "prj10_pair_form": (lambda r: r.select(F.array(F.struct(r.t.alias("human"), r.lang.alias("assistant"))).alias("conversation")), N.conversations, "'user:' || t || '|assistant:' || lang", "true"),
    "prj11_classification": (lambda r: r.select(r.t.alias("query"), (r.doc_id % 3).cast("string").alias("label")), lambda x: N.classification(x).where("label > 0"), "'user:' || t", "doc_id % 3 > 0"),
    "prj12_text_generation": (lambda r: r.select(r.t.alias("query"), r.lang.alias("response")), lambda x: N.text_generation(x, "Say {{QUERY}} now"), "'user:Say ' || t || ' now|assistant:' || lang", "true"),
    "prj13_cls_generation": (lambda r: r.select(r.t.alias("sentence"), F.when(r.doc_id % 4 < 2, r.doc_id % 4).alias("label")), lambda x: N.label_generation(x, ["no", "yes"], "Sentiment"), "'user:Task: Sentiment' || chr(10) || 'Sentence: ' || t || chr(10) || 'Category: no, yes' || chr(10) || 'Output:|assistant:' || CASE WHEN doc_id % 4 = 1 THEN 'yes' ELSE 'no' END", "doc_id % 4 < 2"),
    "prj23_calibration": (lambda r: r.select(r.t.alias("prompt"), r.lang.alias("completion")), N.responses, "'user:' || t || '|assistant:' || lang", "true"),
    "map01_alpaca_zh": (lambda r: r.select(r.t.alias("instruction"), F.concat(F.lit("输入："), r.source).alias("input"), r.lang.alias("output")), P.alpaca_zh, "'user:' || t || chr(10) || source || '|assistant:' || lang", "true"),
    "map02_long_alpaca": (lambda r: r.select(r.t.alias("instruction"), F.lit("").alias("input"), F.concat(F.lit("Answer: "), r.lang).alias("response")), P.long_alpaca, "'user:' || t || '|assistant:' || lang", "true"),
    "map03_ruozhiba": (lambda r: r.select(F.concat(F.lit("12. "), r.source).alias("title"), r.lang.alias("abs")), P.ruozhiba, "'assistant: ' || source || '，' || lang", "true"),
    "map04_math_trn": (lambda r: r.select(r.t.alias("query"), r.lang.alias("response")), P.math_trn, "'user:' || t || '|assistant:' || lang", "true"),
    "map05_ms_bench": (lambda r: r.select(F.array(_ft("system", F.lit("You are a helpful assistant.")), _ft("user", r.source), _ft("assistant", F.when(r.doc_id % 3 == 0, "I am MOSS").otherwise(r.lang))).alias("conversations")), P.ms_bench, "'user:' || source || '|assistant:' || lang", "doc_id % 3 > 0"),
    "map06_ms_agent": (lambda r: r.select(F.array(_ft("system", F.concat(F.lit('1. {"plugin_name": "a"} 2. {"plugin_name": "'), F.when(r.doc_id % 2 == 0, "a").otherwise("b"), F.lit('"}'))), _ft("user", r.lang)).alias("conversations")), P.ms_agent, "'system:1. {\"plugin_name\": \"a\"} 2. {\"plugin_name\": \"b\"}|user:' || lang", "doc_id % 2 = 1"),
    "map07_firefly": (lambda r: r.select(F.when(r.doc_id % 2 == 0, "NLI").otherwise("Other").alias("kind"), r.t.alias("input"), r.lang.alias("target")), P.firefly, "'user:' || t || '|assistant:' || lang", "doc_id % 2 = 0"),
    "map08_text_to_sql": (lambda r: r.select(r.t.alias("sql_prompt"), r.source.alias("sql_context"), r.lang.alias("sql"), r.source.alias("sql_explanation")), P.text_to_sql, "'user:Sql Table information:' || chr(10) || source || chr(10) || t || '|assistant:Let''s think step by step:' || chr(10) || source || chr(10) || 'So the final sql is:' || chr(10) || lang", "true"),
    "map09_toolbench": (lambda r: r.select(F.array(_ft("user", r.t), _ft("caller", r.lang)).alias("conversations")), P.toolbench, "'user:' || t || '|assistant:' || lang", "true"),
    "map10_blossom_math": (lambda r: r.select(r.t.alias("query"), r.source.alias("output"), r.lang.alias("answer")), P.blossom_math, "'user:' || t || '|assistant:' || source || chr(10) || chr(10) || 'Answer: ' || lang", "true"),
    "map11_tiger_law": (lambda r: r.select(r.lang.alias("type"), r.source.alias("title"), r.lang.alias("chapter1"), F.lit(None).cast("string").alias("chapter2"), r.source.alias("chapter3"), r.t.alias("response")), P.tiger_law, "'assistant:' || lang || chr(10) || source || chr(10) || lang || source || t", "true"),
    "map12_leetcode": (lambda r: r.select(F.concat(F.lit("# "), r.source, F.lit("\n```python\nx\n``` ")).alias("code_with_problem"), r.lang.alias("explanation_only")), P.leetcode, "'user:' || source || chr(10) || '|assistant:```python' || chr(10) || 'x' || chr(10) || '```' || chr(10) || chr(10) || lang", "true"),
    "map13_stsb": (lambda r: r.select(r.t.alias("sentence1"), r.lang.alias("sentence2"), (r.doc_id % 5).alias("score")), lambda x: P.stsb(x, 3), "'user:' || t", "doc_id % 5 >= 3"),
    "map14_stsb_generate": (lambda r: r.select(r.source.alias("sentence1"), r.lang.alias("sentence2"), (r.doc_id % 5).alias("score")), P.stsb_generate, "'user:Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || chr(10) || 'Sentence 1: ' || source || chr(10) || 'Sentence 2: ' || lang || chr(10) || 'Similarity score: |assistant:' || (doc_id % 5) || '.0'", "true"),
    "map16_agent_instruct": (lambda r: r.select(F.concat(F.lit("[{'from': 'human', 'value': '"), r.source, F.lit("'}\n {'from': 'gpt', 'value': '"), r.lang, F.lit("'}]")).alias("conversations")), P.agent_instruct, "'user:' || source || '|assistant:' || lang", "true"),
    "map17_repair_conversations": (lambda r: r.select(F.concat(F.lit("[{'role': 'user', 'content': '"), r.source, F.lit("'}{'role': 'assistant', 'content': '"), r.lang, F.lit("'}]")).alias("conversations")), P.repaired_conversations, "'user:' || source || '|assistant:' || lang", "true"),
    "map18_multi_role": (lambda r: r.select(F.array(_ft("user", r.t), _ft("bob", r.source), _ft("amy", r.lang)).alias("conversations")), P.multi_role_agent, "'system:|user:' || t || '|assistant:' || lang", "t <> ''"),
    "map19_countdown": (lambda r: r.select(F.array(r.doc_id, r.doc_id + 1).alias("nums"), r.n_chars.alias("response")), P.countdown, "'user:Using the numbers [' || doc_id || ', ' || (doc_id + 1) || '], create an equation that equals ' || n_chars || '.' || chr(10) || 'You can use basic arithmetic operations (+, -, *, /) and each number can only be used once.' || chr(10) || 'Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.'", "true"),
    "map21_dureader": (lambda r: r.select(F.concat(r.lang, F.lit("[SEP]"), r.source).alias("text1"), r.t.alias("text2")), P.dureader, "'user:Task: Question Generation' || chr(10) || 'Context: ' || source || chr(10) || 'Answer: ' || lang || chr(10) || 'Question:|assistant:' || t", "true"),
    "map22_hh_rlhf": (lambda r: r.select(F.concat(F.lit("\n\nHuman: "), r.source, F.lit("\n\nAssistant: "), r.lang).alias("chosen"), F.lit("\n\nHuman: a\n\nAssistant: b").alias("rejected")), P.hh_rlhf, "'user:' || source || '|assistant:' || lang", "true"),
    "map24_hh_rlhf_cn": (lambda r: r.select(F.array(F.struct(F.lit("human").alias("role"), r.t.alias("text"))).alias("context"), F.struct(F.lit("assistant").alias("role"), r.lang.alias("text")).alias("chosen"), F.struct(F.lit("assistant").alias("role"), r.source.alias("text")).alias("rejected")), P.hh_rlhf_cn, "'user:' || t || '|assistant:' || lang", "true"),
    "map25_emoji": (lambda r: r.select(F.concat(r.t, F.lit("️")).alias("query"), r.lang.alias("response"), r.source.alias("rejected_response")), P.emoji, "'user:' || t || '|assistant:' || lang", "true"),
    "map26_guanaco": (lambda r: r.select(F.concat(F.lit("User:"), r.source, F.when(r.doc_id % 2 == 0, "Assistant:").otherwise("User:"), r.lang).alias("instruction"), F.lit("User: hi").alias("input"), r.lang.alias("output")), P.guanaco, "'user:' || source || '|assistant:' || lang || '|user:hi|assistant:' || lang", "doc_id % 2 = 0"),
    "map27_function_call": (lambda r: r.select(F.array(_ft("system", r.source), _ft("user", r.t), _ft("assistant", r.lang)).alias("conversations"), F.lit("a\n\nb").alias("function_description")), P.function_call_chatml, "'user:' || t || '|assistant:' || lang", "true"),
    "map28_dolly": (lambda r: r.select(r.t.alias("instruction"), F.when(r.doc_id % 2 == 0, r.source).otherwise("").alias("context"), r.lang.alias("response")), P.dolly, "'user:' || CASE WHEN doc_id % 2 = 0 THEN 'Here gives some useful information:' || chr(10) || source || chr(10) ELSE '' END || t || '|assistant:' || lang", "true"),
    "map29_orpo_mix": (lambda r: r.select(F.array(_ft("user", r.t), _ft("assistant", r.lang)).alias("conversations"), F.when(r.doc_id % 2 == 0, "toxic-dpo-v0.2").otherwise("x").alias("source")), P.orpo_dpo_mix, "'user:' || t || '|assistant:' || lang", "doc_id % 2 = 1"),
    "map30_self_cognition": (lambda r: r.select(F.lit("who, {{NAME}}?").alias("query"), F.concat(F.lit("{{NAME}} by {{AUTHOR}} "), r.lang).alias("response"), F.when(r.doc_id % 2 == 0, "zh").otherwise("en").alias("tag")), lambda x: P.self_cognition(x, ("小", "Small"), ("作", "Maker")), "CASE WHEN doc_id % 2 = 0 THEN 'user:who, 小?|assistant:小 by 作 ' ELSE 'user:who, Small?|assistant:Small by Maker ' END || lang", "true"),
    "map32_constant_query": (lambda r: r.select(r.lang.alias("response"), r.source.alias("images")), lambda x: P.constant_query(x, "captcha"), "'user:recognize the content.|assistant:' || lang", "true"),
    "map34_coco2014": (lambda r: r.select(F.concat(r.lang, F.lit("&&"), r.source).alias("caption")), P.coco2014, "'user:please describe the image.|assistant:' || lang", "true"),
    "map38_aishell": (lambda r: r.select(F.concat(r.lang, F.lit(" "), r.source).alias("Text:LABEL")), P.aishell, "'user:语音转文本|assistant:' || lang || source", "true"),
    "map41_video_chatgpt": (lambda r: r.select(F.lit("None").alias("query"), F.when(r.doc_id % 2 == 0, r.lang).otherwise("None").alias("question_1"), F.lit(None).cast("string").alias("question_2"), r.source.alias("response"), r.lang.alias("video_name")), lambda x: P.video_chatgpt(x, "/v"), "'user:' || lang || '|assistant:' || source", "doc_id % 2 = 0"),
    "map48_science_qa": (lambda r: r.select(r.t.alias("question"), F.array(r.lang, r.source).alias("choices"), (r.doc_id % 2).alias("answer"), r.lang.alias("solution")), P.science_qa, "'user:' || t || '|assistant:' || lang || chr(10) || 'So the final answer is: ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END", "true"),
    "map49_grit": (lambda r: r.select(r.source.alias("caption"), F.array(F.array(*[F.lit(float(x)) for x in (0, 2, .1, .1, .2, .2)]), F.array(F.when(r.doc_id % 2 == 0, 1.0).otherwise(2.0), *[F.lit(float(x)) for x in (3, .1, .1, .2, .2)])).alias("ref_exps")), P.grit, "'user:what is the proper caption of this image?|assistant:' || source", "doc_id % 2 = 1"),
    "map50_gqa": (lambda r: r.select(r.t.alias("question"), r.lang.alias("fullAnswer"), r.source.alias("imageId")), lambda x: P.gqa(x, "/g"), "'user:' || t || '|assistant:' || lang", "true"),
    "map51_coco_detection": (lambda r: r.select(F.struct(F.array(F.lit(0), F.lit(1)).alias("category"), F.array(F.array(F.lit(1.0))).alias("bbox")).alias("objects")), lambda x: P.coco_detection(x, ["person", "bicycle"]), "'user:Task: Object Detection|assistant:<ref-object><bbox>' || chr(10) || '<ref-object><bbox>'", "true"),
    "map53_clevr": (lambda r: r.select(r.t.alias("query"), r.lang.alias("response")), P.clevr, "'user:' || t || ' Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags.|assistant:' || lang", "true"),
}

for _name, (_make, _run, _expr, _where) in CASES.items():
    query(_name, _sql(_expr, _where))(lambda s, d, make=_make, run=_run: digest(run(make(rows(s, d)))))


@query("map20_hc3", f"WITH {_D} SELECT md5('user:Classification Task: Are the following responses from a human or from ChatGPT?' || chr(10) || 'Question: ' || t || chr(10) || 'Answer: ' || CASE r WHEN 'Human' THEN lang ELSE source END || chr(10) || 'Category: Human, ChatGPT' || chr(10) || 'Output:|assistant:' || r) AS m FROM d, (SELECT unnest(['Human', 'ChatGPT']) AS r)")
def _(s, d):
    """One row to two."""
    r = rows(s, d)
    return digest(P.hc3(r.select(r.t.alias("query"), F.array(r.lang).alias("human_answers"), F.array(r.source).alias("chatgpt_answers"))))


@query("map23_xlam", f"WITH {_D} SELECT md5('user:' || t || '|tool_call:{{\"name\":\"' || lang || '\"}}|tool_call:{{\"name\":\"b\"}}') AS m FROM d".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    r = rows(s, d)
    a = F.concat(F.lit('[{"name":"'), r.lang, F.lit('"},{"name":"b"}]'))
    return digest(P.xlam(r.select(r.t.alias("query"), a.alias("answers"), F.lit("[]").alias("tools"))))


@query("map15_mteb_rerank", f"WITH {_D} SELECT md5('user:' || t) AS m, 2::BIGINT AS n_positive, 1::BIGINT AS n_negative FROM d")
def _(s, d):
    r = rows(s, d)
    x = P.mteb_rerank(r.select(r.t.alias("query"), F.array(r.lang, r.source).alias("positive"), r.lang.alias("negative")))
    return x.select(F.md5(F.concat(F.lit("user:"), x.messages[0]["content"])).alias("m"), F.size("positive_messages").cast("long").alias("n_positive"), F.size("negative_messages").cast("long").alias("n_negative"))


@query("map36_path_routing", f"WITH {_D} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C/' || source WHEN 1 THEN 'VG_100K/VG_100K/' || source ELSE source END AS path FROM d")
def _(s, d):
    r = rows(s, d)
    raw = F.when(r.doc_id % 3 == 0, F.concat(F.lit("coco/"), r.source)).when(r.doc_id % 3 == 1, F.concat(F.lit("vg/VG_100K/"), r.source)).otherwise(r.source)
    return r.select("doc_id", P.route_path(raw, P.LLAVA_ROUTES, {"coco": "C"}).alias("path"))


@query("map39_egoschema", f"WITH {_D} SELECT md5('user:' || t || chr(10) || lang || chr(10) || source || '|assistant:' || ['A', 'B', 'C'][doc_id % 3 + 1]) AS m FROM d WHERE doc_id % 2 = 0")
def _(s, d):
    r = rows(s, d)
    videos = r.where("doc_id % 2 = 0").select(r.doc_id.cast("string").alias("video_idx"))
    return digest(P.egoschema(r.select(r.doc_id.cast("string").alias("video_idx"), r.t.alias("query"), F.array(r.lang, r.source).alias("option"), (r.doc_id % 3).cast("string").alias("response")), videos, "/v"))


@query("map43_mind2web_sessions", "WITH e AS (SELECT user_id, event_id, event_type, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT user_id, count(*) * 2 AS n_turns, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS images FROM e GROUP BY user_id, s")
def _(s, d):
    """Order-dependent sessions: a marked step starts a conversation."""
    e = table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", "0").otherwise("1").alias("target_action_index"), F.lit("[link] x -> CLICK: y").alias("target_action_reprs"), F.lit("<a>").alias("cleaned_html"), F.lit("go").alias("confirmed_task"), F.col("event_id").cast("string").alias("screenshot"))
    m = P.mind2web(e, "event_id", ["user_id"])
    return m.select("user_id", F.size("messages").cast("long").alias("n_turns"), F.array_join("images", ",").alias("images"))


@query("map45_rerank_negatives", "SELECT doc_id, true AS apart, 3::BIGINT AS n FROM documents")
def _(s, d):
    """Three negatives each, none among a row's own responses."""
    r = table(s, d, "documents").select("doc_id", F.array(F.concat(F.lit("r"), F.col("doc_id").cast("string"))).alias("response"))
    x = P.textcaps_rerank(r, "doc_id", 3)
    texts = F.transform(F.flatten("negative_messages"), lambda m: m["content"])
    return x.select("doc_id", (~F.array_contains(texts, F.concat(F.lit("r"), F.col("doc_id").cast("string")))).alias("apart"), F.size(F.array_distinct(texts)).cast("long").alias("n"))


@query("map52_llava_mix", f"WITH {_D} SELECT md5('user:<image>' || t) AS m FROM d")
def _(s, d):
    r = rows(s, d)
    part = lambda k, t, i: F.struct(F.lit(k).alias("type"), t.alias("text"), i.alias("image"))
    null = F.lit(None).cast("string")
    m = F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", null, r.source), part("text", r.t, null)).alias("content")))
    return digest(P.llava_mix(r.select(m.alias("messages"))))


@query("prj18_flatten_media", f"WITH {_D} SELECT doc_id, md5('user:<image>' || t || CASE WHEN doc_id % 2 = 0 THEN '<image>' ELSE '' END || '|assistant:' || lang) AS m, CASE WHEN doc_id % 2 = 0 THEN source || ',' || lang ELSE source END AS images FROM d")
def _(s, d):
    """Parts of several turns to text with tags, and a list of the images in order."""
    r = rows(s, d)
    part = lambda k, t, i: F.struct(F.lit(k).alias("type"), t.alias("text"), i.alias("image"))
    null = F.lit(None).cast("string")
    first = F.array(part("image", null, r.source), part("text", r.t, null))
    user = F.when(r.doc_id % 2 == 0, F.concat(first, F.array(part("image_url", null, r.lang)))).otherwise(first)
    m = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part("text", r.lang, null)).alias("content")))
    x = r.select("doc_id", N.flatten_media(m).alias("x"))
    return x.select("doc_id", F.md5(F.array_join(F.transform("x.messages", lambda y: F.concat(y["role"], F.lit(":"), y["content"])), "|")).alias("m"), F.array_join("x.images", ",").alias("images"))


@query("prj03_prune", "SELECT doc_id % 2 AS label, source AS channel FROM documents")
def _(s, d):
    r = rows(s, d)
    return N.prune(r.select((r.doc_id % 2).alias("label"), r.source.alias("channel"), "t", "lang"))


@query("prj04_solution_passthrough", f"WITH {_D} SELECT lang AS solution, md5('user:' || t || '|assistant:' || lang) AS m FROM d")
def _(s, d):
    r = rows(s, d)
    x = N.responses(r.select(r.t.alias("query"), r.lang.alias("solution")))
    return x.select("solution", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("m"))


@query("prj05_remove_prefix", "SELECT doc_id AS a, source AS b FROM documents")
def _(s, d):
    r = rows(s, d)
    return N.remove_prefix(r.select(r.doc_id.alias("a"), r.lang.alias("x_a"), r.source.alias("x_b")), "x_")


@query("prj06_cast_media", "SELECT doc_id, source AS path, 1::BIGINT AS n_videos FROM documents")
def _(s, d):
    r = rows(s, d)
    x = N.cast_media(r.select("doc_id", r.source.alias("images"), r.lang.alias("videos")))
    return x.select("doc_id", x.images[0]["path"].alias("path"), F.size("videos").cast("long").alias("n_videos"))


def _hash_sql(text: str) -> str:
    """A number below 2^32 by md5."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


@query("prj14_grounding_mix", f"""WITH h AS (SELECT doc_id, {_hash_sql("'42-lang|' || doc_id")} % 10000 AS u, {_hash_sql("'42|' || doc_id")} AS h FROM documents)
 SELECT doc_id, CASE WHEN u < 8000 THEN ['find it', 'where?'][h % 2 + 1] ELSE ['在哪', '哪里', '指出'][h % 3 + 1] END AS query, CASE WHEN u < 8000 THEN ['here', 'there'][h % 2 + 1] ELSE ['这里', '那里', '此处'][h % 3 + 1] END AS response FROM h""")
def _(s, d):
    """Languages mixed 0.8 to 0.2 by hash, and a prompt of each."""
    prompts = {"en": [("find it", "here"), ("where?", "there")], "zh": [("在哪", "这里"), ("哪里", "那里"), ("指出", "此处")]}
    return N.grounding_prompt(table(s, d, "documents").select("doc_id"), "doc_id", prompts).select("doc_id", "query", "response")


@query("prj17_standard_inputs", f"WITH {_D} SELECT source AS system, md5('user:' || t || '|tool:' || lang) AS m, '{{\"note\":\"' || lang || '\"}}' AS extra FROM d".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    from corpusloom.functions.messages import message

    r = rows(s, d)
    x = N.standard_inputs(r.select(F.array(message("system", r.source), message("user", r.t), message("tool_response", r.lang)).alias("messages"), r.lang.alias("note")))
    return x.select("system", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("m"), "extra")


@query("prj20_preference_inputs", f"WITH {_D} SELECT md5('user:' || t || '|assistant:' || source) AS m, lang AS tools FROM d")
def _(s, d):
    from corpusloom.functions.messages import message

    r = rows(s, d)
    x = N.preference_inputs(r.select(F.array(message("user", r.t), message("assistant", r.lang)).alias("messages"), r.source.alias("rejected_response"), r.lang.alias("tools")))
    return x.select(F.md5(F.array_join(F.transform("rejected_messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("m"), F.col("rejected_tools").alias("tools"))


@query("prj21_image_tags", f"WITH {_D} SELECT doc_id, source || '.png' AS image, 'see <image> ' || lang AS text FROM d")
def _(s, d):
    r = rows(s, d)
    x = T.images_of(F.concat(F.lit("see <img>"), r.source, F.lit(".png</img> "), r.lang))
    return r.select("doc_id", x["images"][0].alias("image"), x["text"].alias("text"))


@query("prj24_surplus_tokens", f"WITH {_D} SELECT doc_id, '<image>a<image>b' || lang AS text FROM d")
def _(s, d):
    r = rows(s, d)
    return r.select("doc_id", T.keep_tokens(F.concat(F.lit("<image>a<image>b<image>"), r.lang), "<image>", F.lit(2)).alias("text"))


@query("prj25_report_rows", "WITH g AS (SELECT source, round(avg(n_chars), 2) AS speed FROM documents GROUP BY source) SELECT source, CASE WHEN speed = min(speed) OVER () THEN '**' || speed::DECIMAL(18, 2) || ' chars**' ELSE speed::DECIMAL(18, 2) || ' chars' END AS cell FROM g")
def _(s, d):
    """Speed cells, the best in bold (a report has few rows)."""
    g = table(s, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 2).alias("speed"))
    best = g.agg(F.min("speed").alias("best"))
    cell = F.concat(F.col("speed").cast("decimal(18,2)").cast("string"), F.lit(" chars"))
    return g.crossJoin(F.broadcast(best)).select("source", F.when(F.col("speed") == F.col("best"), F.concat(F.lit("**"), cell, F.lit("**"))).otherwise(cell).alias("cell"))
