"""Row mappers of known datasets: each takes raw columns and gives canonical ones. All are projections with filters or
explodes; none runs Python except where text holds Python literals. Random choices go by hash of a key column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import messages as M
from corpusloom.functions import text as T
from corpusloom.operators import normalise as N

Mapper = Callable[..., DataFrame]
MAPPERS: dict[str, Mapper] = {}


def mapper(f: Mapper) -> Mapper:
    MAPPERS[f.__name__] = f
    return f


def qa(df: DataFrame, query: Column | None, response: Column | None, system: Column | None = None, *keep: str) -> DataFrame:
    """messages from a query and a response; null parts are left out."""
    null = F.lit(None).cast("string")
    m = M.from_history(F.lit(None).cast("array<array<string>>"), null if query is None else query, null if response is None else response, null if system is None else system)
    return df.select(m.alias("messages"), *[F.col(c) for c in keep if c in df.columns])


def _exists(df: DataFrame, files: DataFrame | None, path: str) -> DataFrame:
    """Rows whose file is in a listing (path); without a listing all stay."""
    return df if files is None else df.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


# Text datasets.


@mapper
def alpaca_zh(df: DataFrame) -> DataFrame:
    """A leading '输入：' goes from the input."""
    return N.alpaca(df.withColumn("input", F.regexp_replace("input", r"\A输入：", "")))


@mapper
def long_alpaca(df: DataFrame) -> DataFrame:
    answer = F.when(F.col("response").startswith("Answer: "), T.strip(F.substr("response", F.lit(len("Answer: ") + 1)))).otherwise(F.col("response"))
    return N.alpaca(df.withColumn("response", answer))


@mapper
def ruozhiba(df: DataFrame) -> DataFrame:
    """Title (else content) and a differing abstract; a leading number goes; empty rows go."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    title = F.coalesce(have("title"), have("content"))
    joined = F.when((have("abs") != "") & (have("abs") != title), F.concat(title, F.lit("，"), have("abs"))).otherwise(title)
    got = F.regexp_extract(joined, r"\d+[\.,\s、](.+)", 1)
    return df.withColumn("_t", F.when(got != "", got).otherwise(joined)).where("_t <> ''").select(F.array(M.message("assistant", F.col("_t"))).alias("messages"))


@mapper
def math_trn(df: DataFrame) -> DataFrame:
    return qa(df, F.col("query"), F.col("response"))


@mapper
def ms_bench(df: DataFrame, default_system: str = "You are a helpful assistant.", banned: tuple[str, ...] = ("moss", "human:", "assistant:", "user:")) -> DataFrame:
    """The default system turn goes; rows with a banned word in any turn go."""
    m = F.col("conversations")
    rest = F.when((m[0]["from"] == "system") & (m[0]["value"] == default_system), F.slice(m, 2, F.size(m))).otherwise(m)
    bad = lambda t: F.exists(F.array(*[F.lit(b) for b in banned]), lambda b: F.contains(F.lower(t["value"]), b))
    return N.conversations(df.withColumn("conversations", rest).where(~F.exists("conversations", bad)))


@mapper
def ms_agent(df: DataFrame, mini: bool = True) -> DataFrame:
    """Mini: only rows whose system turn names more than one plugin."""
    if mini:
        first = F.col("conversations")[0]
        names = F.regexp_extract_all(first["value"], F.lit(r'\d\. \{"plugin_name": "(.+?)"'), F.lit(1))
        df = df.where((first["from"] == "system") & (F.size(F.array_distinct(names)) > 1))
    return N.conversations(df)


#: The kinds that are kept.
FIREFLY_KINDS = (
    "ProseGeneration", "MRC", "JinYongGeneration", "TextCorrection", "ClassicalChinese", "BELLE", "StoryGeneration", "Couplet", "Cot", "Dictionary", "Translation", "Program",
    "SentimentAnalyze", "OpenQA", "AncientPoem", "TextMatching", "NLI", "Summary", "KeywordRecognition", "ProductDesc", "LyricGeneration", "Composition", "MusicComment", "NER",
)


@mapper
def firefly(df: DataFrame, kinds: tuple[str, ...] = FIREFLY_KINDS) -> DataFrame:
    return N.responses(df.where(F.col("kind").isin(*kinds)))


@mapper
def text_to_sql(df: DataFrame) -> DataFrame:
    q = F.format_string("Sql Table information:\n%s\n%s", "sql_context", "sql_prompt")
    return qa(df, q, F.format_string("Let's think step by step:\n%s\nSo the final sql is:\n%s", "sql_explanation", "sql"))


@mapper
def toolbench(df: DataFrame) -> DataFrame:
    """Two turns; a caller's or a conclusion's answer is the assistant's."""
    second = F.col("conversations")[1]
    fixed = F.struct(F.when(second["from"].isin("caller", "conclusion"), "assistant").otherwise(second["from"]).alias("from"), second["value"].alias("value"))
    return N.conversations(df.where(F.size("conversations") == 2).withColumn("conversations", F.array(F.col("conversations")[0], fixed)))


@mapper
def blossom_math(df: DataFrame) -> DataFrame:
    return qa(df, F.col("query"), F.concat("output", F.lit("\n\nAnswer: "), "answer"))


@mapper
def tiger_law(df: DataFrame) -> DataFrame:
    chapters = F.concat(*[F.coalesce(f"chapter{i}", F.lit("")) for i in (1, 2, 3)])
    return qa(df, None, F.concat("type", F.lit("\n"), "title", F.lit("\n"), chapters, "response"))


@mapper
def leetcode(df: DataFrame) -> DataFrame:
    """Problem before the code fence, code and explanation after it."""
    t, at = F.col("code_with_problem"), F.instr("code_with_problem", "```python")
    problem = F.regexp_replace(F.substr(t, F.lit(1), F.greatest(at - 1, F.lit(0))), r"\A# ", "")
    return qa(df, problem, F.concat(T.strip(F.substr(t, at)), F.lit("\n\n"), "explanation_only"))


@mapper
def stsb(df: DataFrame, threshold: float | None = None) -> DataFrame:
    out = df if threshold is None else df.where(F.col("score").cast("double") >= threshold)
    return out.select(F.array(M.message("user", F.col("sentence1"))).alias("messages"), F.array(F.array(M.message("user", F.col("sentence2")))).alias("positive_messages"), F.col("score").alias("label"))


_STS = "Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.\nSentence 1: %s\nSentence 2: %s\nSimilarity score: "


@mapper
def stsb_generate(df: DataFrame) -> DataFrame:
    return qa(df, F.format_string(_STS, "sentence1", "sentence2"), F.format_string("%.1f", F.col("score").cast("double")))


@mapper
def stsb_regression(df: DataFrame) -> DataFrame:
    return qa(df.withColumn("label", F.col("score")), F.format_string(_STS, "sentence1", "sentence2"), None, None, "label")


def _as_array(df: DataFrame, c: str) -> Column:
    return F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(c)


@mapper
def mteb_rerank(df: DataFrame) -> DataFrame:
    wrap = lambda c: F.transform(_as_array(df, c), lambda x: F.array(M.message("assistant", x)))
    return df.select(F.array(M.message("user", F.col("query"))).alias("messages"), wrap("positive").alias("positive_messages"), wrap("negative").alias("negative_messages"))


@mapper
def agent_instruct(df: DataFrame) -> DataFrame:
    """Literal lists whose items lack commas."""
    return N.conversations(df, role_key="from", content_key="value")


@mapper
def repaired_conversations(df: DataFrame) -> DataFrame:
    return N.conversations(df)


@mapper
def multi_role_agent(df: DataFrame, notice: str = "\n\n【注意事项】\n1. 这是聊天室，不要发送私信给任何人\n2. 仅代表你个人说话,不要扮演其他人，只根据对话历史进行回复\n3. 长话短说，不要说太多话，不要超过50字 ", history: str = "\n\n【chat history】") -> DataFrame:
    """A user's first turn is the query; else the middle turns join the system text. Rows without query or answer go."""
    c = F.col("conversations")
    system = F.when(c[0]["from"] == "system", c[0]["value"]).otherwise("")
    middle = F.array_join(F.transform(F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))), lambda t: F.concat(F.lit("\n "), t["from"], F.lit(":"), t["value"])), "")
    query = F.when(c[0]["from"] == "user", c[0]["value"]).otherwise("")
    noted = F.when(~F.contains(system, F.lit("【注意事项】")) & (system != ""), F.concat(system, F.lit(notice))).otherwise(system)
    full = F.when((query == "") & ~F.contains(system, F.lit("next_speakers:")), F.concat(noted, F.lit(history), middle)).otherwise(system)
    rows = df.select(full.alias("s"), query.alias("q"), F.try_element_at(c, F.lit(-1))["value"].alias("r")).where("q <> '' AND r <> ''")
    return rows.select(F.array(M.message("system", F.col("s")), M.message("user", F.col("q")), M.message("assistant", F.col("r"))).alias("messages"))


@mapper
def countdown(df: DataFrame) -> DataFrame:
    target = "response" if "response" in df.columns else "target"
    text = F.format_string(
        "Using the numbers [%s], create an equation that equals %s.\nYou can use basic arithmetic operations (+, -, *, /) and each number can only be used once.\n"
        "Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.",
        F.array_join(F.col("nums").cast("array<string>"), ", "), F.col(target).cast("string"))
    return qa(df.withColumn("target", F.col(target)), text, None, None, "nums", "target")


_HC3 = "Classification Task: Are the following responses from a human or from ChatGPT?\nQuestion: %s\nAnswer: %s\nCategory: Human, ChatGPT\nOutput:"


def _hc3(df: DataFrame, seed: object) -> DataFrame:
    pick = lambda c: N.hashed_choice(F.col(c), seed, "query")
    two = F.explode(F.array(*[F.struct(pick(f"{n.lower()}_answers").alias("answer"), F.lit(n).alias("response"), F.lit(i).alias("label")) for i, n in enumerate(("Human", "ChatGPT"))]))
    return df.select("query", two.alias("x")).select(F.format_string(_HC3, "query", "x.answer").alias("query"), "x.response", "x.label")


@mapper
def hc3(df: DataFrame, seed: object = 42) -> DataFrame:
    """Two rows of each: one human and one machine answer."""
    rows = _hc3(df, seed)
    return qa(rows, F.col("query"), F.col("response"))


@mapper
def hc3_cls(df: DataFrame, seed: object = 42) -> DataFrame:
    return qa(_hc3(df, seed), F.col("query"), None, None, "label")


@mapper
def dureader(df: DataFrame) -> DataFrame:
    parts = F.split("text1", r"\[SEP\]")
    rows = df.where(F.size(parts) == 2)
    return qa(rows, F.format_string("Task: Question Generation\nContext: %s\nAnswer: %s\nQuestion:", parts[1], parts[0]), F.col("text2"))


def _dialogue(c: Column) -> Column:
    parts = F.transform(F.split(T.strip(c), "\n\nHuman:|\n\nAssistant:|\n\nHum:"), lambda s: T.strip(s))
    parts = F.transform(parts, lambda s, i: F.when(i == 0, T.strip(F.regexp_replace(s, r"\AHuman:", ""))).otherwise(s))
    parts = F.slice(parts, 1, F.size(parts) - F.size(parts) % 2)
    return F.transform(parts, lambda s, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), s.alias("content")))


@mapper
def hh_rlhf(df: DataFrame) -> DataFrame:
    return df.select(_dialogue(F.col("chosen")).alias("messages"), _dialogue(F.col("rejected")).alias("rejected_messages"))


@mapper
def xlam(df: DataFrame) -> DataFrame:
    """Every answer is a tool call."""
    calls = F.transform(F.from_json("answers", "array<string>"), lambda a: M.message("tool_call", a))
    return df.select(F.concat(F.array(M.message("user", F.col("query"))), calls).alias("messages"), "tools")


@mapper
def xlam_grpo(df: DataFrame, seed: object = 42) -> DataFrame:
    """One answer, by hash, as action text; it is the solution too."""
    name = "response" if "response" in df.columns else "answers"
    one = N.hashed_choice(F.from_json(name, "array<string>"), seed, "query")
    text = F.concat(F.lit("Action: "), F.get_json_object(one, "$.name"), F.lit("\nAction Input: "), F.get_json_object(one, "$.arguments"))
    return qa(df.withColumn("solution", text), F.col("query"), text, None, "solution", "tools")


@mapper
def hh_rlhf_cn(df: DataFrame) -> DataFrame:
    """context and the chosen turn (role, text); the rejected turn's text."""
    turn = lambda m: F.struct(N.std_role(m["role"]).alias("role"), m["text"].alias("content"))
    return df.select(F.concat(F.transform("context", turn), F.array(turn(F.col("chosen")))).alias("messages"), F.col("rejected.text").alias("rejected_response"))


@mapper
def emoji(df: DataFrame) -> DataFrame:
    """Variation selectors go."""
    bare = lambda c: F.replace(F.col(c), F.lit("️"), F.lit(""))
    return qa(df.withColumn("rejected_response", bare("rejected_response")), bare("query"), bare("response"), None, "rejected_response")


#: speakers' marks.
GUANACO_MARKS = ("User:", "User：", "Assistant：", "Assistant:", "Asssistent:", "Assistent:", "Assistenz:")


@mapper
def guanaco(df: DataFrame) -> DataFrame:
    """The instruction is a dialogue of marked turns that must alternate and not be empty; then input and output."""
    parts = F.when(F.col("instruction") != "", T.split_parts(F.col("instruction"), list(GUANACO_MARKS))).otherwise(F.array().cast("array<struct<key:string,content:string>>"))
    user = lambda p: F.contains(F.lower(p["key"]), F.lit("user"))
    helper = lambda p: F.lower(p["key"]).rlike("assist|asssist")
    flags = F.transform("p", lambda p, i: F.when(i % 2 == 0, user(p)).otherwise(helper(p)) & (p["content"] != ""))
    rows = df.withColumn("p", parts).where(F.forall(flags, lambda x: x) & (F.size("p") % 2 == 0))
    past = F.transform("p", lambda p, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), p["content"].alias("content")))
    last = F.when(F.col("input").startswith("User:"), T.strip(F.regexp_replace("input", r"\AUser:", ""))).otherwise(F.col("input"))
    return rows.select(F.concat(past, F.array(M.message("user", last), M.message("assistant", F.col("output")))).alias("messages"))


@mapper
def function_call_chatml(df: DataFrame) -> DataFrame:
    """Tools by blank lines; the system turn goes."""
    out = N.conversations(df)
    m = F.col("messages")
    rest = F.when(m[0]["role"] == "system", F.slice(m, 2, F.size(m))).otherwise(m)
    return out.select(rest.alias("messages"), F.when(F.col("function_description") != "", F.split("function_description", "\n\n")).alias("tools"))


@mapper
def dolly(df: DataFrame) -> DataFrame:
    head = F.when(F.col("context") != "", F.concat(F.lit("Here gives some useful information:\n"), "context", F.lit("\n"))).otherwise("")
    return qa(df, F.concat(head, "instruction"), F.col("response"))


@mapper
def orpo_dpo_mix(df: DataFrame) -> DataFrame:
    return N.conversations(df.where("source <> 'toxic-dpo-v0.2'"))


@mapper
def self_cognition(df: DataFrame, name: tuple[str, str], author: tuple[str, str], query_suffix: str = "", response_prefix: str = "") -> DataFrame:
    """Placeholders filled in the row's language (tag zh: the first of each pair)."""
    pick = lambda pair: F.when(F.col("tag") == "zh", pair[0]).otherwise(pair[1])
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{{NAME}}"), pick(name)), F.lit("{{AUTHOR}}"), pick(author))
    return qa(df, F.concat(fill("query"), F.lit(query_suffix)), F.concat(F.lit(response_prefix), fill("response")))


# Datasets with media. `files` is a listing (path) of what is there; without it nothing is checked.


@mapper
def share_gpt4o(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    rows = df.where("image <> ''").withColumn("path", F.concat(F.lit(root + "/"), "image"))
    return N.conversations(_exists(rows, files, "path").withColumn("images", F.array("path")).drop("image", "path"))


#: The constant query of each dataset.
CONSTANT_QUERIES = {"gpt4v": "What is the caption of this image?", "garbage": "Task: Classify household waste.", "latexocr": "Using LaTeX to perform OCR on the image.", "captcha": "recognize the content."}


@mapper
def constant_query(df: DataFrame, dataset: str) -> DataFrame:
    return qa(df, F.lit(CONSTANT_QUERIES[dataset]), F.col("response"), None, "images")


SA1B_PROMPTS = ["图片中展示了什么", "讲述一下图片中内容", "告诉我里面有什么", "图片内容是啥"]


@mapper
def sa1b_paired(df: DataFrame, key: str = "global_caption", seed: object = 42) -> DataFrame:
    return qa(df, N.hashed_choice(SA1B_PROMPTS, seed, key), F.col("global_caption"), None, "images")


@mapper
def sa1b_dense(df: DataFrame, seed: object = 42) -> DataFrame:
    """The caption is inside a literal dict."""
    return qa(df, N.hashed_choice(SA1B_PROMPTS, seed, "cap_seg"), F.get_json_object(N.literal_json("cap_seg"), "$.global_caption"), None, "images")


@mapper
def coco2014(df: DataFrame) -> DataFrame:
    return qa(df, F.lit("please describe the image."), F.split("caption", "&&")[0], None, "images")


@mapper
def mantis(df: DataFrame, root: str, files: DataFrame | None = None, key: str = "id") -> DataFrame:
    """All images of a row must be there: the ones found are counted against the ones named."""
    named = df.withColumn("images", F.transform("images", lambda p: F.concat(F.lit(root + "/"), p["path"]))).where(F.size("images") > 0)
    if files is not None:
        lacking = named.select(key, F.explode("images").alias("path")).join(files.select("path"), "path", "left_anti").select(key).distinct()
        named = named.join(lacking, key, "left_anti")
    return N.conversations(named)


#: Folder of a path, what goes from it and what comes instead.
LLAVA_ROUTES = (("coco/", "coco", "coco/", ""), ("gqa/", "gqa", "gqa/", ""), ("ocr_vqa/", "ocr_vqa", "", ""), ("textvqa/", "textvqa", "textvqa/", ""), ("VG_100K/", "VG_100K", "vg/", ""), ("VG_100K_2/", "VG_100K_2", "vg/", ""))
SHARE_GPT4V_ROUTES = (("coco/", "coco", "coco/", ""), ("sam/", "sam", "sam/images/", ""), ("llava/", "llava", "llava/llava_pretrain/images/", ""), ("wikiart/", "wikiart", "wikiart/images/", "data/wikiart/images/"), ("share_textvqa/", "share_textvqa", "share_textvqa/images/", "data/share_textvqa/images/"), ("web-celebrity/", "web-celebrity", "web-celebrity/images/", "data/web-celebrity/images/"), ("web-landmark/", "web-landmark", "web-landmark/images/", "data/web-landmark/images/"))


def route_path(path: Column, routes: tuple[tuple[str, str, str, str], ...], roots: dict[str, str]) -> Column:
    """The first route whose mark is in the path decides its root and its new form."""
    out = None
    for mark, folder, old, new in routes:
        moved = F.concat(F.lit(roots.get(folder, folder) + "/"), F.replace(path, F.lit(old), F.lit(new)) if old else path)
        hit = F.contains(path, F.lit(mark))
        out = F.when(hit, moved) if out is None else out.when(hit, moved)
    return out.otherwise(path)


@mapper
def routed_images(df: DataFrame, routes: tuple = LLAVA_ROUTES, roots: dict[str, str] | None = None, files: DataFrame | None = None, column: str = "image") -> DataFrame:
    rows = df.withColumn("path", route_path(F.col(column), routes, roots or {}))
    return N.conversations(_exists(rows, files, "path").withColumn("images", F.array("path")).drop("path", column if column != "images" else "_"))


#: The prompts, and the one of speech transcription.
PIXELPROSE_PROMPTS = ["Give the description of this image.", "Describe this picture", "What is the proper title of this image?"]


@mapper
def pixelprose(df: DataFrame, seed: object = 42) -> DataFrame:
    caption = F.when(F.col("vlm_caption").startswith("This image displays:"), T.strip(F.substr("vlm_caption", F.lit(len("This image displays:") + 1)))).otherwise(F.col("vlm_caption"))
    return qa(df.withColumn("images", F.col("url")), N.hashed_choice(PIXELPROSE_PROMPTS, seed, "url"), caption, None, "images")


TRANSCRIBE = "语音转文本"


@mapper
def aishell(df: DataFrame) -> DataFrame:
    return qa(df, F.lit(TRANSCRIBE), F.replace(F.col("`Text:LABEL`"), F.lit(" "), F.lit("")), None, "audios")


def _egoschema(df: DataFrame, videos: DataFrame, root: str) -> DataFrame:
    rows = df.join(videos.select("video_idx").distinct(), "video_idx", "left_semi")  # Spark broadcasts a listing that is small enough
    return rows.withColumn("query", F.concat("query", F.lit("\n"), F.array_join("option", "\n"))).withColumn("videos", F.array(F.concat(F.lit(root + "/"), "video_idx", F.lit(".mp4"))))


@mapper
def egoschema(df: DataFrame, videos: DataFrame, root: str) -> DataFrame:
    rows = _egoschema(df, videos, root)
    letter = F.try_element_at(F.array(*[F.lit(x) for x in "ABCDE"]), F.col("response").cast("int") + 1)
    return qa(rows, F.col("query"), letter, None, "videos")


@mapper
def egoschema_cls(df: DataFrame, videos: DataFrame, root: str) -> DataFrame:
    rows = _egoschema(df, videos, root).withColumn("label", F.col("response").cast("int"))
    return qa(rows, F.col("query"), None, None, "label", "videos")


@mapper
def llava_video(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    rows = df.withColumn("path", F.concat(F.lit(root + "/"), "videos"))
    return _exists(rows, files, "path").select("messages", F.array("path").alias("videos"))


@mapper
def moviechat(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    rows = df.withColumn("path", F.concat(F.lit(root + "/"), F.col("info.video_path")))
    first = F.col("global")[0]
    return qa(_exists(rows, files, "path").withColumn("videos", F.array("path")), first["question"], first["answer"], None, "videos")


@mapper
def video_chatgpt(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    """The first of three questions that is there and not 'None'; rows without any go."""
    q = F.coalesce(*[F.nullif(F.col(c), F.lit("None")) for c in ("query", "question_1", "question_2") if c in df.columns])
    rows = df.withColumn("_q", q).where("_q IS NOT NULL").withColumn("path", F.concat(F.lit(root + "/"), "video_name", F.lit(".mp4")))
    return qa(_exists(rows, files, "path").withColumn("videos", F.array("path")), F.col("_q"), F.col("response"), None, "videos")


@mapper
def llava_pretrain(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    rows = df.where("image <> ''").withColumn("path", F.concat(F.lit(root + "/"), "image"))
    return _exists(rows, files, "path").select(F.array("path").alias("images"))


@mapper
def mind2web(df: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """A new conversation starts at target_action_index '0'; its steps fold into one row.

    `by` bounds the ordered runs (a site or an annotation); without it one task orders all rows.
    """
    w = W.partitionBy(*(by or [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    action = F.split("target_action_reprs", "->")
    last = F.try_element_at(action, F.lit(-1))
    where = F.when(F.size(action) > 1, T.strip(action[0])).otherwise("")
    has = F.contains(last, F.lit(":"))
    name = F.when(has, F.regexp_extract(last, r"(?s)\A([^:]*):", 1)).otherwise(last)
    what = F.when(has, F.regexp_extract(last, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise("")
    start = F.col("target_action_index") == "0"
    query = F.concat(F.lit("The snapshot of screen:<image>\nThe html source code:"), "cleaned_html", F.lit("\n"), F.when(start, F.concat(F.lit("\n"), "confirmed_task")).otherwise(""))
    answer = F.concat(F.lit("Action: "), T.strip(name), F.lit("\nAction Input: "), where, F.lit(","), T.strip(what))
    rows = df.withColumn("_session", F.sum(start.cast("int")).over(w)).select(*(by or []), "_session", F.struct(F.col(order).alias("o"), query.alias("q"), answer.alias("a"), F.col("screenshot").alias("i")).alias("s"))
    folded = rows.groupBy(*(by or []), "_session").agg(F.array_sort(F.collect_list("s")).alias("s"))
    turns = F.flatten(F.transform("s", lambda x: F.array(M.message("user", x["q"]), M.message("assistant", x["a"]))))
    return folded.select(*(by or []), turns.alias("messages"), F.transform("s", lambda x: x["i"]).alias("images"))


@mapper
def textcaps(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    rows = _exists(df.withColumn("path", F.col("images.path")), files, "path")
    return qa(rows, F.lit(CONSTANT_QUERIES["gpt4v"]), F.get("response", 0), None, "images")


@mapper
def textcaps_emb(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    rows = _exists(df.withColumn("path", F.col("images.path")), files, "path")
    return rows.select(F.array(M.message("user", F.lit("<image>"))).alias("messages"), F.array(F.array(M.message("user", F.get("response", 0)))).alias("positive_messages"), "images")


@mapper
def textcaps_rerank(df: DataFrame, key: str, negatives: int = 7, seed: object = 42, slots: int = 1024) -> DataFrame:
    """Negatives from the pool of all responses, none among the row's own.

    The pool is dealt into `slots` hashed lists that grow with it no further than negatives plus a row's own
    responses need; each row reads the list its hash names, so nothing is crossed.
    """
    pool = df.select(F.explode("response").alias("s")).distinct()
    place = F.row_number().over(W.partitionBy("slot").orderBy(F.xxhash64(F.lit(str(seed)), "s"), "s"))
    most = df.agg(F.max(F.size("response"))).first()[0] or 0
    lists = pool.withColumn("slot", F.pmod(F.xxhash64("s"), F.lit(min(slots, max(1, pool.count() // (4 * (negatives + most) + 1)))))).withColumn("k", place).where(F.col("k") <= negatives + most)
    n = lists.agg(F.max("slot")).first()[0]
    lists = lists.groupBy("slot").agg(F.collect_list("s").alias("pool"))
    rows = df.withColumn("slot", F.pmod(F.xxhash64(F.lit(str(seed)), F.col(key)), F.lit((n or 0) + 1))).join(lists, "slot")
    chosen = F.slice(F.array_sort(F.array_except("pool", "response"), lambda a, b: F.when(F.xxhash64(a) < F.xxhash64(b), -1).otherwise(1)), 1, negatives)
    wrap = lambda x: F.array(M.message("user", x))
    return rows.select(key, F.array(M.message("user", F.lit("<image>"))).alias("messages"), F.array(wrap(F.get("response", 0))).alias("positive_messages"), F.transform(chosen, wrap).alias("negative_messages"))


@mapper
def refcoco(df: DataFrame, root: str, prompts: dict, key: str = "image_path", files: DataFrame | None = None) -> DataFrame:
    rows = df.withColumn("path", F.concat(F.lit(root + "/"), F.replace(F.col("image_path"), F.lit("coco/train2014"), F.lit("train2014"))))
    rows = N.grounding_prompt(_exists(rows, files, "path"), key, prompts)
    objects = F.struct(F.array(F.get("captions", 0)).alias("ref"), F.array(F.transform("bbox", lambda x: F.rint(x))).alias("bbox"))
    return qa(rows.withColumns({"objects": objects, "images": F.array("path")}), F.col("query"), F.col("response"), None, "images", "objects")


@mapper
def ocrvqa(df: DataFrame, key: str, seed: object = 42) -> DataFrame:
    """One pair of questions and answers, by hash."""
    pair = N.hashed_choice(F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a")), seed, key)
    return qa(df.withColumn("_p", pair), F.col("_p.q"), F.col("_p.a"), None, "images")


@mapper
def science_qa(df: DataFrame) -> DataFrame:
    choice = F.try_element_at("choices", F.col("answer").cast("int") + 1)
    return qa(df, F.col("question"), F.concat("solution", F.lit("\nSo the final answer is: "), choice), None, "images")


@mapper
def grit(df: DataFrame, query: str = "what is the proper caption of this image?") -> DataFrame:
    """Referring spans (start, end, box) must not overlap; rows without spans go."""
    spans = F.array_sort(F.transform("ref_exps", lambda r: F.struct(r[0].alias("a"), r[1].alias("b"))))
    rows = df.withColumn("_s", spans).where(F.size("ref_exps") > 0)
    later = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    clash = F.exists(F.zip_with(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0))), later, lambda x, y: y["a"] < x["b"]), lambda c: c)
    ref = F.transform("ref_exps", lambda r: F.substring(F.col("caption"), r[0].cast("int") + 1, (r[1] - r[0]).cast("int")))
    objects = F.struct(ref.alias("ref"), F.transform("ref_exps", lambda r: F.slice(r, 3, 4)).alias("bbox"), F.lit("norm1").alias("bbox_type"))
    return qa(rows.where(~clash).withColumn("objects", objects), F.lit(query), F.col("caption"), None, "images", "objects")


def tagged_spans(caption: Column, spans: Column, tag: str = "<ref-object><bbox>") -> Column:
    """caption with sorted, disjoint spans replaced by a tag."""
    step = lambda t, s: F.struct(F.concat(t["out"], F.substring(caption, t["at"] + 1, s["a"].cast("int") - t["at"]), F.lit(tag)).alias("out"), s["b"].cast("int").alias("at"))
    end = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.concat(end["out"], F.substr(caption, end["at"] + 1))


@mapper
def gqa(df: DataFrame, root: str, files: DataFrame | None = None) -> DataFrame:
    """Images are checked against the listing if there is one."""
    rows = df.withColumn("path", F.concat(F.lit(root + "/images/"), "imageId", F.lit(".jpg")))
    return qa(_exists(rows, files, "path").withColumn("images", F.array("path")), F.col("question"), F.col("fullAnswer"), None, "images")


@mapper
def coco_detection(df: DataFrame, categories: list[str]) -> DataFrame:
    """Category numbers become names; one tag pair for each object."""
    names = F.transform("objects.category", lambda c: F.get(F.array(*[F.lit(x) for x in categories]), c.cast("int")))
    rows = df.withColumn("objects", F.struct(names.alias("ref"), F.col("objects.bbox").alias("bbox")))
    return qa(rows, F.lit("Task: Object Detection"), F.array_join(F.array_repeat(F.lit("<ref-object><bbox>"), F.size("objects.ref")), "\n"), None, "images", "objects")


@mapper
def llava_mix(df: DataFrame) -> DataFrame:
    return df.select(N.flatten_media(F.col("messages"))["messages"].alias("messages"), *[c for c in ("images",) if c in df.columns])


@mapper
def clevr(df: DataFrame) -> DataFrame:
    hint = " Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags."
    return qa(df, F.concat(F.coalesce("query", F.lit("")), F.lit(hint)), F.col("response"), None, "images", "solution")


#: Classes by number.
VOC_CLASSES = ("aeroplane", "bicycle", "bird", "boat", "bottle", "bus", "car", "cat", "chair", "cow", "diningtable", "dog", "horse", "motorbike", "person", "pottedplant", "sheep", "sofa", "train", "tvmonitor")


@mapper
def voc2007(df: DataFrame) -> DataFrame:
    label = F.filter(F.transform("npy", lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    return qa(df.withColumn("label", label), F.lit(f"多标签分类，类别包括：{list(VOC_CLASSES)}"), None, None, "label", "images")


@mapper
def geometry3k(df: DataFrame) -> DataFrame:
    return qa(df.withColumn("solution", F.col("response")), F.col("query"), F.col("response"), None, "solution", "images")
