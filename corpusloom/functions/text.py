"""Text expressions: splitting, extraction, truncation, tool-call parsing. All are built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bound

#: Python's str.split() white space that Java's \s lacks is added by (?U).
WORDS = r"(?U)\S+"


def quoted(delimiters: list[str]) -> str:
    """An alternation of literal strings, longer ones first where one begins another."""
    return "|".join(r"\Q" + d + r"\E" for d in sorted(delimiters, key=lambda x: -len(x)))


def split_parts(text: Column, delimiters: list[str], regex: bool = False) -> Column:
    """array<struct<key, content>>: text cut at delimiters; key is the delimiter before a part ('' for a first part without).

    Loss-less: keys and contents joined give the text.
    """
    a = "|".join(delimiters) if regex else quoted(delimiters)
    whole = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{a})(?:(?!{a}).)*|\A(?:(?!{a}).)+"), F.lit(0))
    head = lambda p: F.regexp_extract(p, rf"(?s)\A({a})?", 1)
    return F.transform(whole, lambda p: F.struct(head(p).alias("key"), F.substr(p, F.length(head(p)) + 1).alias("content")))


def strip(text: Column) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def truncate(ids: Column, length: int, side: str = "right", protected: Column | None = None) -> Column:
    """An array cut to `length`; elements in `protected` survive first, the order stays."""
    if side == "raise":
        return F.when(F.size(ids) <= length, ids).otherwise(F.raise_error(F.lit("the sequence is too long")).cast("array<int>"))
    if protected is None:
        return F.slice(ids, 1, length) if side == "right" else bound(ids, lambda x: F.slice(x, F.greatest(F.size(x) - length + 1, F.lit(1)), length))
    pairs = F.transform(ids, lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.array_contains(protected, x).alias("p")))
    order = F.transform(pairs, lambda s: F.struct((~s["p"]).cast("int").alias("a"), (s["i"] if side == "right" else -s["i"]).alias("b"), s["i"].alias("i"), s["x"].alias("x")))
    kept = F.slice(F.array_sort(order), 1, length)
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def split_chunks(ids: Column, length: int) -> Column:
    """array of arrays of at most `length`."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(length)), lambda i: F.slice(x, i, length))
    return bound(ids, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.array(x)))


def answer_tag(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1))


def boxed(text: Column) -> Column:
    """The last \\boxed{...} without nested braces, or with one level of them."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), F.lit(1)), F.lit(-1)), F.lit(""))


def hash_answer(text: Column) -> Column:
    """What follows '# Answer'."""
    return strip(F.regexp_extract(text, r"(?s)# Answer\s*(.*)\z", 1))


def code_fence(text: Column, language: str = "python") -> Column:
    """The content of the last fenced block of a language."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```{re.escape(language)}\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit(""))


def reward_score(text: Column) -> Column:
    """The number after 'Reward:', or null."""
    got = F.regexp_extract(text, r"Reward:\s*(-?\d+(?:\.\d+)?)", 1)
    return F.when(got != "", got).try_cast("double")


def react_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of Action / Action Input pairs."""
    p = r"(?s)Action:\s*(.*?)\nAction Input:\s*(.*?)(?=\nObservation:|\nAction:|\z)"
    return _calls(text, p)


#: The formats of tool calls. Group 1 is the name, group 2 the arguments.
TOOL_FORMATS = {
    "react": r"(?s)Action:\s*(.*?)\nAction Input:\s*(.*?)(?=\nObservation:|\nAction:|\z)",
    "hunyuan": r'(?s)<tool_call>(\w+)\n```json\n(.*?)\n```</tool_call>',
    "glm4": r"(?s)\A(\w+)\n(\{.*\})",
    "glm4_5": r"(?s)<tool_call>([^<\n]+)\n?(.*?)</tool_call>",
    "llama3": r'(?s)"name":\s*"([^"]+)",\s*"parameters":\s*(\{.*?\})\s*\}',
    "mistral": r'(?s)"name":\s*"([^"]+)",\s*"arguments":\s*(\{.*?\})\s*\}',
    "deepseek": r"(?s)<｜tool▁call▁begin｜>(.*?)<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>",
    "qwen3_coder": r"(?s)<function=([^>]+)>(.*?)</function>",
    "seed": r"(?s)<seed:tool_call>\s*<function=([^>]+)>(.*?)</function>",
}


def _calls(text: Column, pattern: str) -> Column:
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.zip_with(names, F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda n, a: F.struct(strip(n).alias("name"), strip(a).alias("arguments")))


def tool_calls(text: Column, kind: str) -> Column:
    """array<struct<name, arguments>> in one of TOOL_FORMATS, or 'hermes' (JSON in <tool_call> tags)."""
    if kind == "hermes":
        blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
        named = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
        return F.filter(named, lambda c: c["name"].isNotNull())
    return _calls(text, TOOL_FORMATS[kind])


def tag_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)))


def tool_prompt(tools: Column, kind: str = "react") -> Column:
    """A system prompt that lists tools (array of JSON objects with name and description)."""
    name = lambda t: F.coalesce(F.get_json_object(t, "$.function.name"), F.get_json_object(t, "$.name"))
    lines = F.array_join(F.transform(tools, lambda t: F.concat(name(t), F.lit(": "), F.coalesce(F.get_json_object(t, "$.function.description"), F.get_json_object(t, "$.description"), F.lit("")))), "\n")
    if kind == "hermes":
        return F.concat(F.lit("# Tools\n\n<tools>\n"), F.array_join(tools, "\n"), F.lit("\n</tools>"))
    return F.concat(F.lit("You can use these tools:\n"), lines, F.lit("\nUse one of ["), F.array_join(F.transform(tools, name), ","), F.lit("]"))


def parse_tools(tools: Column) -> Column:
    """Tools given as one JSON array text: array of JSON objects, each unwrapped from {type, function}."""
    items = F.from_json(tools, "array<string>")
    return F.transform(items, lambda t: F.coalesce(F.get_json_object(t, "$.function"), t))


def scale_parts(text: Column, scales: dict[str, tuple[float, float]]) -> Column:
    """array<struct<text, weight>>: at each delimiter its own weight, for its content the second one; 1 before the first."""
    parts = split_parts(text, list(scales))
    pick = lambda key, k: F.coalesce(F.element_at(F.create_map(*[x for d, w in scales.items() for x in (F.lit(d), F.lit(w[k]))]), F.nullif(key, F.lit(""))), F.lit(1.0))
    both = F.flatten(F.transform(parts, lambda p: F.array(F.struct(p["key"].alias("text"), pick(p["key"], 0).alias("weight")), F.struct(p["content"].alias("text"), pick(p["key"], 1).alias("weight")))))
    return merge_scales(F.filter(both, lambda s: s["text"] != ""))


def merge_scales(segments: Column) -> Column:
    """Adjacent segments of equal weight joined."""
    def step(out: Column, s: Column) -> Column:
        top = F.try_element_at(out, F.lit(-1))
        both = F.struct(F.concat(top["text"], s["text"]).alias("text"), s["weight"].alias("weight"))
        same = (F.size(out) > 0) & (top["weight"] == s["weight"])
        return F.when(same, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(F.struct(s["text"].alias("text"), s["weight"].alias("weight")))))

    return F.aggregate(segments, F.array().cast("array<struct<text:string,weight:double>>"), step)


def parse_scale_spec(spec: str) -> tuple[str, str | None]:
    """'strategy+type' or either alone."""
    strategy, plus, kind = spec.partition("+")
    known = ("default", "last_round", "all")
    if plus:
        return strategy, kind
    return (spec, None) if spec in known else ("default", spec)


def scale_spec(spec: Column) -> tuple[Column, Column]:
    """parse_scale_spec of a column: (strategy, kind)."""
    both, alone = spec.contains("+"), spec.isin("default", "last_round", "all")
    strategy = F.when(both, F.substring_index(spec, "+", 1)).when(alone, spec).otherwise("default")
    return strategy, F.when(both, F.substring(spec, F.locate("+", spec) + 1, F.length(spec))).when(~alone, spec)


def path_fields(path: Column) -> dict[str, Column]:
    """What a result path tells: ratio, seed, method, and whether super rows are kept."""
    return {
        "method": F.regexp_extract(path, r"/([a-z_]+?)[-_](?:\d+\.\d+|seed)", 1),
        "ratio": F.nullif(F.regexp_extract(path, r"[-_](\d+\.\d+)", 1), F.lit("")).try_cast("double"),
        "seed": F.nullif(F.regexp_extract(path, r"seed[-_](\d+)", 1), F.lit("")).try_cast("int"),
        "preserve": path.contains("preserve_super"),
    }


def images_of(text: Column) -> Column:
    """struct(images, text): <img>path</img> become <image> tags."""
    p = r"(?s)<img>(.+?)</img>"
    return F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("images"), F.regexp_replace(text, p, "<image>").alias("text"))


def normalised_boxes(boxes: Column, width: Column, height: Column, kind: str = "real") -> Column:
    """Boxes scaled to 0..1000 with half-even rounding; kind real (pixels) or norm1 (0..1)."""
    size = lambda i: F.when(i % 2 == 0, width).otherwise(height)
    one = (lambda x, i: F.rint(x / size(i) * 1000)) if kind == "real" else (lambda x, i: F.rint(x * 1000))
    return F.transform(boxes, lambda b: F.transform(b, lambda x, i: one(x, i).cast("int")))


def ordered_boxes(boxes: Column) -> Column:
    """Corners of four-number boxes put in order."""
    return F.transform(boxes, lambda b: F.when(F.size(b) == 4, F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))).otherwise(b))


def valid_boxes(boxes: Column) -> Column:
    return F.coalesce(F.forall(boxes, lambda b: F.size(b).isin(2, 4)), F.lit(True))


def modality(path: Column) -> Column:
    """image, video or audio by extension; another raises."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"), "image").when(ext.isin("mp4", "mkv", "mov", "avi", "webm", "mpg", "mpeg"), "video").when(ext.isin("mp3", "wav", "ogg", "flac", "aac", "m4a"), "audio").otherwise(F.raise_error(F.concat(F.lit("unknown media type: "), path)).cast("string"))


def keep_tokens(text: Column, token: str, n: Column) -> Column:
    """Only the first n of a token stay."""
    parts = F.split(text, re.escape(token))
    head = F.array_join(F.slice(parts, 1, (F.least(n, F.size(parts) - 1) + 1).cast("int")), token)
    rest = F.when(F.size(parts) > n + 1, F.array_join(F.slice(parts, (n + 2).cast("int"), F.size(parts)), "")).otherwise("")
    return F.concat(head, rest)
