"""Queries over conversations and documents: normalised messages, validity, rendering, arrays, text and rewards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import messages as M
from corpusloom.functions import rewards as R
from corpusloom.functions import text as T
from corpusloom.plans.registry import query, r6
from corpusloom.session import table


def chats(s: SparkSession, d: str) -> DataFrame:
    return M.from_turns(table(s, d, "conversations"), "conv_id", "turn", "role", "text")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Turns to messages, validated, the answer split off, rendered, and lengths summarised by the last role."""
    from corpusloom.operators.aggregates import stat_array

    m = chats(s, d).where(M.valid(F.col("messages")))
    m = m.select("conv_id", M.last(F.col("messages"))["role"].alias("last_role"), M.without_response(F.col("messages")).alias("prompt"))
    rows = m.select("last_role", F.length(M.render(F.col("prompt"))).alias("n"))
    out = stat_array(rows, F.col("n"), ["last_role"])
    return out.select("last_role", r6("mean", "mean"), r6("std", "std"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "size")


_C = "c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"
_REN = "CASE WHEN role = 'system' THEN '<|im_start|>system\n' || text || '<|im_end|>\n' WHEN role = 'user' THEN '<|im_start|>user\n' || text || '<|im_end|>\n<|im_start|>assistant\n' ELSE text || '<|im_end|>\n' END"

query("flagship_prompt_lengths", f"""WITH {_C}, p AS (SELECT conv_id, arg_max(role, turn) AS last_role, coalesce(sum(length({_REN})) FILTER (NOT (turn = last AND role = 'assistant')), 0) AS n FROM c GROUP BY conv_id)
 SELECT last_role, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, count(*) AS size FROM p GROUP BY last_role""")(flagship)


@query("flt01_check_messages", "SELECT conv_id, count(*) > 0 AND bool_and(text IS NOT NULL AND role IN ('system', 'user', 'tool_call', 'tool_response', 'tool', 'assistant')) AS ok FROM conversations GROUP BY conv_id")
def _(s, d):
    return chats(s, d).select("conv_id", M.valid(F.col("messages")).alias("ok"))


@query("flt02_check_rejected", f"WITH {_C} SELECT conv_id FROM c WHERE turn = last AND text <> CASE WHEN conv_id % 5 = 0 THEN text ELSE 'other' END")
def _(s, d):
    m = chats(s, d).withColumn("rejected", F.when(F.col("conv_id") % 5 == 0, M.last(F.col("messages"))["content"]).otherwise("other"))
    return m.where(M.valid_rejected(F.col("messages"), F.col("rejected"))).select("conv_id")


_BOX = "b AS (SELECT event_id, [(value % 100)::DOUBLE, ((event_id * 7) % 100)::DOUBLE, ((event_id * 13) % 100)::DOUBLE, (user_id % 100)::DOUBLE] AS b FROM events)"


def _boxes(s: SparkSession, d: str) -> DataFrame:
    b = F.array((F.col("value") % 100).cast("double"), (F.col("event_id") * 7 % 100).cast("double"), (F.col("event_id") * 13 % 100).cast("double"), (F.col("user_id") % 100).cast("double"))
    return table(s, d, "events").select("event_id", F.array(b).alias("b"))


@query("flt03_check_objects", f"WITH {_BOX} SELECT event_id, round(least(b[1], b[3]), 6) AS x1, round(least(b[2], b[4]), 6) AS y1, round(greatest(b[1], b[3]), 6) AS x2, round(greatest(b[2], b[4]), 6) AS y2 FROM b")
def _(s, d):
    b = _boxes(s, d).where(T.valid_boxes(F.col("b"))).withColumn("o", T.ordered_boxes(F.col("b"))[0])
    return b.select("event_id", *[r6(F.col("o")[i], n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("prj22_bbox_normalise", f"WITH {_BOX} SELECT event_id, round_even(b[1] / 640 * 1000, 0)::INT AS x1, round_even(b[2] / 480 * 1000, 0)::INT AS y1, round_even(b[3] / 640 * 1000, 0)::INT AS x2, round_even(b[4] / 480 * 1000, 0)::INT AS y2 FROM b")
def _(s, d):
    b = _boxes(s, d).withColumn("o", T.normalised_boxes(F.col("b"), F.lit(640.0), F.lit(480.0))[0])
    return b.select("event_id", *[F.col("o")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("flt04_error_policy", "SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'bad length' END AS error FROM documents WHERE n_chars % 7 = 0")
def _(s, d):
    """The rows that a lenient run puts in quarantine."""
    from corpusloom.operators.filters import quarantine

    docs = table(s, d, "documents").select("doc_id", "n_chars")
    return quarantine(docs, F.when(F.col("n_chars") % 7 == 0, F.lit("bad length")))[1].select("doc_id", F.col("_error").alias("error"))


@query("flt05_length_filter", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(length(text)) <= 1000")
def _(s, d):
    from corpusloom.operators.filters import fits

    m = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("lengths"))
    return fits(m, "lengths", 1000).select("conv_id")


@query("flt06_overlong_mask", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) < 800")
def _(s, d):
    return table(s, d, "conversations").where("role = 'assistant'").withColumn("is_truncated", F.length("text") >= 800).where(~F.col("is_truncated")).select("conv_id", "turn")


@query("flt08_skip_paths", "SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['fr', 'de'])")
def _(s, d):
    from corpusloom.operators.filters import without_path_parts

    return without_path_parts(table(s, d, "pages"), "url", ["fr", "de"]).select("page_id")


@query("prj15_history", f"WITH {_C}, r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM c WHERE role <> 'system') SELECT conv_id, (k // 2)::BIGINT AS round, md5(coalesce(max(text) FILTER (k % 2 = 0), '') || '|' || coalesce(max(text) FILTER (k % 2 = 1), '')) AS pair FROM r GROUP BY conv_id, k // 2")
def _(s, d):
    m = chats(s, d).select("conv_id", F.posexplode(M.to_history(F.col("messages"))["history"]).alias("round", "p"))
    return m.select("conv_id", F.col("round").cast("long").alias("round"), F.md5(F.concat(F.coalesce(F.col("p")[0], F.lit("")), F.lit("|"), F.coalesce(F.col("p")[1], F.lit("")))).alias("pair"))


@query("prj16_remove_response", f"WITH {_C} SELECT conv_id, count(*) FILTER (NOT (turn = last AND role = 'assistant')) AS n_left, md5(max(text) FILTER (turn = last AND role = 'assistant')) AS label FROM c GROUP BY conv_id")
def _(s, d):
    m = F.col("messages")
    return chats(s, d).select("conv_id", F.size(M.without_response(m)).cast("long").alias("n_left"), F.md5(M.response(m)).alias("label"))


@query("prj19_rejected_messages", "WITH u AS (SELECT conv_id, max(turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, md5(string_agg(text, '|' ORDER BY turn) || '|no') AS h FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn <= u.u GROUP BY c.conv_id")
def _(s, d):
    m = chats(s, d).withColumn("r", M.rejected_messages(F.col("messages"), F.lit("no")))
    return m.select("conv_id", F.md5(F.array_join(F.transform("r", lambda x: x["content"]), "|")).alias("h"))


@query("win08_last_user_round", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, coalesce(max(i) FILTER (role = 'user'), -1)::BIGINT AS at FROM r GROUP BY conv_id")
def _(s, d):
    return chats(s, d).select("conv_id", M.last_user_index(F.col("messages")).alias("at"))


_ISL = "p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, {r} ORDER BY turn) AS isl FROM {t})"


@query("win09_merge_same_role", "WITH f AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'user' ELSE role END AS role FROM conversations), l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM f), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role OR role NOT IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT conv_id, (isl - 1)::BIGINT AS pos, any_value(role) AS role, md5(string_agg(text, chr(10) ORDER BY turn)) AS content FROM g GROUP BY conv_id, isl")
def _(s, d):
    """Every third turn is given to the user; equal neighbours are merged."""
    t = table(s, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")))
    m = M.from_turns(t, "conv_id", "turn", "role", "text")
    m = m.select("conv_id", F.posexplode(M.merged(F.col("messages"))).alias("pos", "m"))
    return m.select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", F.md5("m.content").alias("content"))


@query("win10_tool_runs", "WITH f AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' OR turn % 3 = 2 THEN 'tool_call' ELSE role END AS role FROM conversations), l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM f), g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role OR role <> 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT conv_id, (isl - 1)::BIGINT AS pos, CASE WHEN any_value(role) = 'tool_call' THEN 'assistant' ELSE any_value(role) END AS role, md5(string_agg(text, chr(10) ORDER BY turn)) AS content FROM g GROUP BY conv_id, isl")
def _(s, d):
    t = table(s, d, "conversations").withColumn("role", F.when((F.col("role") == "assistant") | (F.col("turn") % 3 == 2), "tool_call").otherwise(F.col("role")))
    m = M.from_turns(t, "conv_id", "turn", "role", "text").select("conv_id", F.posexplode(M.tool_runs(F.col("messages"))).alias("pos", "m"))
    return m.select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", F.md5("m.content").alias("content"))


@query("txt01_split_parts", "WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) SELECT doc_id, len(p)::BIGINT - CASE WHEN p[1] = '' THEN 1 ELSE 0 END AS n_parts, true AS lossless FROM p")
def _(s, d):
    """Cut at line ends; keys and contents give the text back."""
    p = table(s, d, "documents").select("doc_id", "text", T.split_parts(F.col("text"), ["\n"]).alias("p"))
    back = F.array_join(F.transform("p", lambda x: F.concat(x["key"], x["content"])), "")
    return p.select("doc_id", F.size("p").cast("long").alias("n_parts"), (back == F.col("text")).alias("lossless"))


@query("txt02_chat_render", f"SELECT conv_id, md5(string_agg({_REN}, '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def _(s, d):
    return chats(s, d).select("conv_id", F.md5(M.render(F.col("messages"))).alias("text"))


@query("txt04_chatml_default_system", f"SELECT conv_id, md5(CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|im_start|>system\nBe kind.<|im_end|>\n' END || string_agg({_REN}, '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def _(s, d):
    return chats(s, d).select("conv_id", F.md5(M.render(F.col("messages"), default_system="Be kind.")).alias("text"))


@query("txt05_strip_thinking", "SELECT conv_id, turn, trim(text, chr(10) || ' ') AS text FROM conversations WHERE role = 'assistant'")
def _(s, d):
    t = table(s, d, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", M.strip_thinking(F.concat(F.lit("<think>hm</think>"), "text")).alias("text"))


_W = r"regexp_extract_all(text, '[^ \t\n\r\x0b\f]+')"


@query("txt07_truncate_split", f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 100)) AS pos FROM w) SELECT doc_id, (pos // 100)::BIGINT AS chunk, len(w[pos + 1:pos + 100])::BIGINT AS n FROM c")
def _(s, d):
    w = table(s, d, "documents").select("doc_id", F.posexplode(T.split_chunks(T.words(F.col("text")), 100)).alias("chunk", "c"))
    return w.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"))


@query("txt07_truncate_left", f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, md5(array_to_string(w[greatest(len(w) - 49, 1):], ' ')) AS kept FROM w")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(T.truncate(T.words(F.col("text")), 50, "left"), " ")).alias("kept"))


@query("txt08_encode_lengths", f"SELECT doc_id, len({_W})::BIGINT AS length FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("length"))


_REACT = r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN e'Thought: hm\nAction:  lookup \nAction Input: ' || text || e'\nObservation: none' WHEN 1 THEN e'Action: a\nAction Input:  \t' || text || e' \n\nAction: b\nAction Input: ' || role
   WHEN 2 THEN e'Action: one\nAction Input: {}\nObservation: Action Input: no\nThought: again\nAction: two\nAction Input: ' || text ELSE text || e'\nAction: without input' END AS r FROM conversations),
 p AS (SELECT conv_id, turn, unnest(string_split_regex(r, 'Action:\s*')[2:]) AS p FROM t WHERE r LIKE '%Action:%')
 SELECT conv_id, turn, regexp_replace(split_part(p, e'\nAction Input:', 1), '^\s+|\s+$', '', 'g') AS name, regexp_replace(regexp_replace(split_part(p, e'\nAction Input:', 2), '(?s)\nObservation:.*', ''), '^\s+|\s+$', '', 'g') AS arguments
 FROM p WHERE contains(p, e'\nAction Input:')"""


@query("txt11_react_calls", _REACT)
def _(s, d):
    """Tool calls parsed back from whole turns: blanks around names and inputs, two calls, observations between, a call without input."""
    k, text = F.col("turn") % 4, F.col("text")
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    r = F.when(k == 0, joined("Thought: hm\nAction:  lookup \nAction Input: ", text, "\nObservation: none")).when(k == 1, joined("Action: a\nAction Input:  \t", text, " \n\nAction: b\nAction Input: ", F.col("role")))
    r = r.when(k == 2, joined("Action: one\nAction Input: {}\nObservation: Action Input: no\nThought: again\nAction: two\nAction Input: ", text)).otherwise(joined(text, "\nAction: without input"))
    return table(s, d, "conversations").select("conv_id", "turn", F.explode(T.tool_calls(r, "react")).alias("c")).select("conv_id", "turn", "c.name", "c.arguments")


@query("txt12_hermes_calls", "SELECT event_id, 'f' || user_id AS name, '{\"v\":' || (event_id % 10) || '}' AS arguments FROM events")
def _(s, d):
    text = F.concat(F.lit('Well.\n<tool_call>\n{"name": "f'), F.col("user_id").cast("string"), F.lit('", "arguments": {"v": '), (F.col("event_id") % 10).cast("string"), F.lit("}}\n</tool_call>"))
    return table(s, d, "events").select("event_id", F.explode(T.tool_calls(text, "hermes")).alias("c")).select("event_id", "c.name", "c.arguments")


@query("txt15_loss_scale", "WITH u AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id) SELECT conv_id, turn, (role = 'assistant')::INT::DOUBLE AS scale, (role = 'assistant' AND turn > coalesce(u, -1))::INT::DOUBLE AS last_round FROM conversations JOIN u USING (conv_id)")
def _(s, d):
    m = F.col("messages")
    z = chats(s, d).select("conv_id", F.posexplode(F.arrays_zip(M.loss_scales(m).alias("a"), M.loss_scales(m, "last_round").alias("b"))).alias("turn", "z"))
    return z.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("z.a").alias("scale"), F.col("z.b").alias("last_round"))


@query("txt18_path_fields", "SELECT user_id, event_id, 'prune' AS method, round((event_id % 100) / 100.0 + 0.01, 2) AS ratio, (user_id % 50)::INT AS seed, event_id % 2 = 0 AS preserve FROM events")
def _(s, d):
    ratio = F.round((F.col("event_id") % 100) / 100 + 0.01, 2)
    path = F.concat(F.lit("out/prune-"), F.format_number(ratio, 2), F.lit("-seed_"), (F.col("user_id") % 50).cast("string"), F.when(F.col("event_id") % 2 == 0, "-preserve_super").otherwise(""), F.lit("/eval"))
    p = T.path_fields(path)
    return table(s, d, "events").select("user_id", "event_id", *[c.alias(n) for n, c in p.items()])


@query("txt19_answer_extraction", "SELECT doc_id, lang AS answer, lang AS boxed FROM documents")
def _(s, d):
    t = F.concat(F.lit("x <answer> "), "lang", F.lit(" </answer> \\boxed{a} \\boxed{"), "lang", F.lit("}"))
    return table(s, d, "documents").select("doc_id", T.answer_tag(t).alias("answer"), T.boxed(t).alias("boxed"))


@query("txt20_query_text", "SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'system' THEN 'System' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn)) AS query FROM conversations GROUP BY conv_id")
def _(s, d):
    return chats(s, d).select("conv_id", F.md5(M.query_text(F.col("messages"))).alias("query"))


_IDS = "i AS (SELECT user_id, list((event_id % 5)::INT ORDER BY event_id) AS ids FROM events GROUP BY user_id)"


def _ids(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id"))).alias("r"))
    return e.select("user_id", F.transform("r", lambda x: (x["event_id"] % 5).cast("int")).alias("ids"))


@query("arr01_findall", f"WITH {_IDS} SELECT user_id, i - 1 AS at FROM (SELECT user_id, ids, unnest(range(1, len(ids))) AS i FROM i) WHERE ids[i] = 1 AND ids[i + 1] = 3")
def _(s, d):
    return _ids(s, d).select("user_id", F.explode(A.find_all(F.col("ids"), F.array(F.lit(1), F.lit(3)))).alias("at")).select("user_id", F.col("at").cast("long").alias("at"))


@query("arr03_pad_collate", f"WITH {_IDS}, m AS (SELECT max(len(ids)) AS m FROM i) SELECT user_id, m::BIGINT AS width, (list_sum(ids) - 100 * (m - len(ids)))::BIGINT AS total FROM i, m")
def _(s, d):
    ids = _ids(s, d)
    both = ids.crossJoin(F.broadcast(ids.agg(F.max(F.size("ids")).alias("m"))))
    p = A.pad(F.col("ids"), F.col("m"), F.lit(-100))
    return both.select("user_id", F.size(p).cast("long").alias("width"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("arr04_one_hot", "SELECT event_id, k AS cls, (k = event_id % 4 OR k = user_id % 4)::INT::DOUBLE AS hot FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)")
def _(s, d):
    h = A.one_hot(F.array(F.col("event_id") % 4, F.col("user_id") % 4), 4)
    return table(s, d, "events").select("event_id", F.posexplode(h).alias("cls", "hot"))


@query("arr05_zigzag", f"WITH {_IDS}, p AS (SELECT user_id, ids, len(ids) // 4 AS n FROM i) SELECT user_id, coalesce(list_sum(ids[1:n]) + list_sum(ids[3 * n + 1:4 * n]), 0)::BIGINT AS total FROM p")
def _(s, d):
    z = A.zigzag(F.col("ids"), 0, 2)
    return _ids(s, d).select("user_id", F.aggregate(z, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("arr06_top_logprobs", "WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS t FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, t) AS k FROM e) SELECT vec_id, t::INT AS token, round(v, 6) AS logprob FROM r WHERE k <= 3")
def _(s, d):
    e = F.col("embedding").cast("array<double>")
    m = F.map_from_arrays(F.sequence(F.lit(0), F.size(e) - 1), e)
    rows = table(s, d, "embeddings").select("vec_id", F.explode(A.top_logprobs(m, 3)).alias("t"))
    return rows.select("vec_id", "t.token", r6("t.logprob", "logprob"))


@query("arr07_replace_assistant", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'r' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) ELSE md5(text) END AS content FROM conversations")
def _(s, d):
    """The n assistant turns of a conversation take n numbered rounds."""
    m = chats(s, d).select("conv_id", F.transform("messages", lambda x: x["role"]).alias("r"), F.transform("messages", lambda x: F.md5(x["content"])).alias("c"))
    n = F.size(F.filter("r", lambda x: x == "assistant"))
    rounds = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("r"), i.cast("string")))
    out = m.select("conv_id", F.posexplode(A.replace_assistant(F.col("r"), F.col("c"), rounds)).alias("turn", "content"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "content")


@query("arr08_left_pad", f"WITH {_IDS}, m AS (SELECT max(len(ids)) AS m FROM i) SELECT user_id, (m - len(ids))::BIGINT AS n_pad, ids[1] AS first_real FROM i, m")
def _(s, d):
    ids = _ids(s, d)
    both = ids.crossJoin(F.broadcast(ids.agg(F.max(F.size("ids")).alias("m"))))
    p = A.pad(F.col("ids").cast("array<double>"), F.col("m"), F.lit(-1e10), left=True)
    n = F.size(F.filter(p, lambda x: x < -1e9))
    return both.select("user_id", n.cast("long").alias("n_pad"), F.get(p, n).cast("int").alias("first_real"))


@query("arr09_classification_decode", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, list_position(e, list_max(e)) - 1 AS label, len([x FOR x IN e IF x >= 0])::BIGINT AS n_multi, round(list_max(e) - ln(list_sum([exp(x) FOR x IN e])), 6) AS top_logprob FROM v""")
def _(s, d):
    e = F.col("embedding").cast("array<double>")
    return table(s, d, "embeddings").select("vec_id", A.argmax(e).cast("long").alias("label"), F.size(A.sigmoid_labels(e)).cast("long").alias("n_multi"), r6(A.class_logprobs(e, 1)[0]["logprob"], "top_logprob"))


# Rewards: a document's text plays the completion. Rows take different forms, and the SQL reads each anew.
def _form(forms: list[Column], key: str = "doc_id") -> Column:
    """The form of a row, by turns."""
    out = forms[-1]
    for k in range(len(forms) - 2, -1, -1):
        out = F.when(F.pmod(F.col(key), F.lit(len(forms))) == k, forms[k]).otherwise(out)
    return out


def _parts(kind: str) -> list[str]:
    return [x for x in re.split(r"(\{(?:text|lang|source)\})", kind) if x]


def _forms(kinds: list[str]) -> Column:
    """A row's form of templates with {text}, {lang}, {source}."""
    return _form([F.concat(*[F.col(x[1:-1]) if x in ("{text}", "{lang}", "{source}") else F.lit(x) for x in _parts(k)]) for k in kinds])


def _forms_sql(kinds: list[str]) -> str:
    one = lambda x: x[1:-1] if x in ("{text}", "{lang}", "{source}") else "'" + x.replace("'", "''") + "'"
    return f"CASE doc_id % {len(kinds)} " + " ".join(f"WHEN {i} THEN {' || '.join(map(one, _parts(k)))}" for i, k in enumerate(kinds)) + " END"


_THINK = ["<think>{text}</think> \n<answer>{lang}</answer>", "<think>{text}</think> \n<answer>{lang}</answer> more", "x<think>{text}</think><answer>{lang}</answer>", "<think>{text}</think><answer>{source}\n{lang}</answer>", "<think>{text}<answer>{lang}</answer>", "<think></think>{lang}<answer></answer>", "<think>{lang}</think><answer>a</answer><answer>b</answer>"]
_REACT = ["<think>{text}</think>\nAction: a\nAction Input: {lang}", "<think>{text}</think>\nDone", "preface\n<think>{lang}</think>\nAction: a\nAction Input: b", "<think>{lang}</think>Action:Action Input:", "<think>{lang}\nAction: a\nAction Input: b", "<think>{text}</think> {source} Action: a\nAction Input: b\nObservation: c"]
_EXACT = ["x<answer> {lang}</answer>", "<answer>{lang}\n</answer> and <answer>de</answer>", "  {lang} ", "<answer>{lang}", "{source}", "<answer>en de</answer>"]
_CODE = ["<think>x</think>\n<answer>```{lang}\npass\n```</answer>", "<think>{text}</think><answer>```python\n{text}\n```</answer>\n ", "<answer>```{lang}\n```</answer>", "<think>x</think> y <answer>```{lang}\n```</answer>", "<think>x</think><answer>```{lang}\n```</answer> end"]
_TOOL = ["<think>x</think>\n<tool_call>\na\n</tool_call>\n<response>{lang}</response>", "<think>{text}</think>\n<response>{lang}</response>", "<think>x</think>\n<tool_call>\n{source}\n</tool_call>", "<think>{lang}</think>", "<think>x</think>\n<tool_call>a</tool_call>", "<think>x</think>\n<tool_call>\na\n</tool_call>\n<tool_call>\nb\n</tool_call>", "x<think>y</think>"]
_DOCS = "FROM documents)"


@query("rwd01_format", rf"WITH c AS (SELECT doc_id, {_forms_sql(_THINK)} AS c {_DOCS} SELECT doc_id, regexp_full_match(c, '<think>.*?</think>\s*<answer>.*?</answer>', 's')::INT::DOUBLE AS reward FROM c")
def _(s, d):
    return table(s, d, "documents").select("doc_id", R.format_reward(_forms(_THINK)).alias("reward"))


@query("rwd02_react_format", rf"WITH c AS (SELECT doc_id, {_forms_sql(_REACT)} AS c {_DOCS} SELECT doc_id, regexp_matches(c, '^<think>.*?</think>\s*Action:.*?Action Input:', 's')::INT::DOUBLE AS reward FROM c")
def _(s, d):
    return table(s, d, "documents").select("doc_id", R.react_format(_forms(_REACT)).alias("reward"))


@query("rwd03_cosine_length", "WITH l AS (SELECT doc_id, n_chars AS n, doc_id % 2 = 0 AS ok FROM documents), p AS (SELECT doc_id, n, CASE WHEN ok THEN 1.0::DOUBLE ELSE -0.5 END AS a, CASE WHEN ok THEN 0.5::DOUBLE ELSE 0.0 END AS b FROM l) SELECT doc_id, round(a - (a - b) * (1 - cos(n * pi() / 1000)) / 2, 6) AS reward FROM p")
def _(s, d):
    return table(s, d, "documents").select("doc_id", r6(R.cosine_length(F.col("n_chars"), F.col("doc_id") % 2 == 0), "reward"))


@query("rwd04_repetition", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\r\x0b\f]+') AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) < 3 THEN 0 ELSE len(list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]))::DOUBLE / (len(w) - 2) - 1 END, 6) AS reward FROM w")
def _(s, d):
    return table(s, d, "documents").select("doc_id", r6(R.repetition(F.col("text")), "reward"))


@query("rwd05_soft_overlong", "SELECT doc_id, round(least(-(n_chars - 1500) / 500.0, 0), 6) AS reward FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", r6(R.soft_overlong(F.col("n_chars"), 2000, 500), "reward"))


_ACTS = """a AS (SELECT event_id, event_type AS t, event_id % 4 AS k, CASE event_id % 7 WHEN 0 THEN 9 WHEN 1 THEN event_id % 3 ELSE event_id % 4 END AS v, CASE WHEN event_id % 7 = 2 THEN 'other' ELSE event_type END AS name, CASE event_id % 7 WHEN 3 THEN '{"a": 1}' WHEN 4 THEN 'free words' ELSE NULL END AS odd FROM events)"""


@query("rwd06_toolbench", f"""WITH {_ACTS}, i AS (SELECT event_id, name = t AS same, coalesce(odd, '{{{{"b": 1, "a": ' || v || '}}}}') AS have, CASE WHEN event_id % 14 = 4 THEN 'free words' ELSE '{{{{"a": ' || k || ', "b": 1}}}}' END AS want FROM a)
 SELECT event_id, (same AND (have = want OR coalesce(list_sort(json_keys(try_cast(have AS JSON))) = list_sort(json_keys(try_cast(want AS JSON))) AND try_cast(have AS JSON)->>'a' = try_cast(want AS JSON)->>'a' AND try_cast(have AS JSON)->>'b' = try_cast(want AS JSON)->>'b', false)))::INT::DOUBLE AS reward FROM i""".replace("{{", "{").replace("}}", "}"))
def _(s, d):
    """Other names, values, key orders and lacking keys, and inputs that are plain text."""
    e, k = F.col("event_id"), (F.col("event_id") % 4).cast("string")
    call = lambda name, args: F.concat(F.lit("Thought: x\nAction: "), name, F.lit("\nAction Input: "), args)
    value = F.when(e % 7 == 0, 9).when(e % 7 == 1, e % 3).otherwise(e % 4).cast("string")
    have = F.when(e % 7 == 3, '{"a": 1}').when(e % 7 == 4, "free words").otherwise(F.concat(F.lit('{"b": 1, "a": '), value, F.lit("}")))
    want = F.when(e % 14 == 4, "free words").otherwise(F.concat(F.lit('{"a": '), k, F.lit(', "b": 1}')))
    name = F.when(e % 7 == 2, "other").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", R.react_score(call(name, have), call(F.col("event_type"), want)).alias("reward"))


@query("rwd07_accuracy", """WITH n AS (SELECT event_id, event_id % 6 AS f, user_id % 40 AS a, event_id % 40 AS b, event_type AS t FROM events)
 SELECT event_id, (CASE f WHEN 0 THEN a = b WHEN 1 THEN a * 2 = b * 2 WHEN 2 THEN a + 0.5 = b + 0.5 WHEN 3 THEN t = 'click' WHEN 4 THEN abs(a / 4.0 - b / 4.0) < 1e-9 ELSE a = b END)::INT::DOUBLE AS reward FROM n""")
def _(s, d):
    """Answers in tags, after words, as decimals, words, quotients and with thousands separators."""
    f, t = F.col("event_id") % 6, F.col("event_type")
    a, b = (F.col("user_id") % 40).cast("string"), (F.col("event_id") % 40).cast("string")
    c = F.when(f == 0, F.concat(F.lit("so <answer> "), a, F.lit(" </answer>"))).when(f == 1, F.concat(F.lit("it is "), (F.col("user_id") % 40 * 2).cast("string"))).when(f == 2, F.concat(a, F.lit(".50")))
    c = c.when(f == 3, F.concat(F.lit("<answer>"), t, F.lit("</answer>"))).when(f == 4, F.concat(F.lit("\\boxed{"), a, F.lit("/4}"))).otherwise(F.concat(F.lit("<answer>1,0"), F.lpad(a, 2, "0"), F.lit("</answer>")))
    w = F.when(f == 1, (F.col("event_id") % 40 * 2).cast("string")).when(f == 2, F.concat(b, F.lit(".5"))).when(f == 3, F.lit("click")).when(f == 4, (F.col("event_id") % 40 / 4).cast("string")).when(f == 5, F.concat(F.lit("10"), F.lpad(b, 2, "0"))).otherwise(b)
    return table(s, d, "events").select("event_id", R.vectorised(R.math_accuracy)(c, w).alias("reward"))


@query("rwd08_math", """WITH n AS (SELECT event_id, event_id % 9 AS f, user_id % 30 + 1 AS a, event_id % 30 + 1 AS b FROM events)
 SELECT event_id, (CASE f WHEN 0 THEN a * 2 = b * 2 WHEN 1 THEN a * b = b * b WHEN 4 THEN a = b + 1 ELSE a = b END)::INT::DOUBLE AS reward FROM n""")
def _(s, d):
    """Boxed answers: fractions against whole numbers, the last box of several, dollars, \\text, a sum, an equation, a square
    against its expansion, a quotient of polynomials and a root."""
    f, e, u = F.col("event_id") % 9, F.col("event_id") % 30 + 1, F.col("user_id") % 30 + 1
    a, b = u.cast("string"), e.cast("string")
    frac = lambda x, y: F.concat(F.lit("\\frac{"), x.cast("string"), F.lit("}{"), y.cast("string"), F.lit("}"))
    box = lambda x: F.concat(F.lit("so $\\boxed{"), x, F.lit("}$."))
    c = F.when(f == 0, box(frac(u * 2, F.lit(2)))).when(f == 1, F.concat(box(F.lit("99999")), box(frac(u * e, e)))).when(f == 2, box(F.concat(F.lit("\\text{"), a, F.lit("}")))).when(f == 3, box(F.concat(a, F.lit("\\%")))).when(f == 4, box(a))
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    c = c.when(f == 5, box(joined("x = ", a))).when(f == 6, box(joined("(x+", a, ")^2"))).when(f == 7, box(joined("\\frac{y^2-", (u * u).cast("string"), "}{y+", a, "}"))).otherwise(box(joined("\\sqrt{", (u * u).cast("string"), "}")))
    w = F.when(f == 4, F.concat(b, F.lit(" + 1"))).when(f == 6, joined("x^2 + ", (e * 2).cast("string"), "x + ", (e * e).cast("string"))).when(f == 7, joined("y - ", b)).otherwise(F.concat(F.lit("$"), b, F.lit("$")))
    return table(s, d, "events").select("event_id", R.vectorised(R.math_accuracy)(c, w).alias("reward"))


@query("rwd09_countdown", """WITH n AS (SELECT event_id, event_id % 6 AS f, event_id % 9 + 1 AS a, user_id % 9 + 1 AS b, (event_id // 7) % 30 AS target FROM events)
 SELECT event_id, (CASE f WHEN 0 THEN (a + b) * 2 = target WHEN 1 THEN a + b * 2 = target WHEN 2 THEN a - b + 2 = target WHEN 3 THEN false WHEN 4 THEN abs(a / (b * 2.0) - target) < 1e-5 ELSE false END)::INT::DOUBLE AS reward FROM n""")
def _(s, d):
    """Equations of several shapes, one that leaves out a number and one that is no arithmetic."""
    e = F.col("event_id")
    a, b, f = (e % 9 + 1).cast("string"), (F.col("user_id") % 9 + 1).cast("string"), e % 6
    target = (F.floor(e / 7) % 30).cast("string")
    eq = F.when(f == 0, F.concat(F.lit("("), a, F.lit("+"), b, F.lit(")*2 = ?"))).when(f == 1, F.concat(a, F.lit(" + "), b, F.lit(" * 2"))).when(f == 2, F.concat(a, F.lit("-"), b, F.lit("+2="), target)).when(f == 3, F.concat(a, F.lit("+"), b))
    eq = eq.when(f == 4, F.concat(a, F.lit("/("), b, F.lit("*2)"))).otherwise(F.concat(a, F.lit("?"), b, F.lit("?2")))
    task = F.concat(F.lit('{"nums": ['), a, F.lit(","), b, F.lit(',2], "target": '), target, F.lit("}"))
    return table(s, d, "events").select("event_id", R.vectorised(R.countdown)(F.concat(F.lit("<answer>"), eq, F.lit("</answer>")), task).alias("reward"))


_PICK = r"CASE WHEN regexp_matches({0}, '<answer>.*?</answer>', 's') THEN regexp_replace(regexp_extract({0}, '<answer>(.*?)</answer>', 1, 's'), '^\s+|\s+$', '', 'g') ELSE trim({0}) END"


@query("rwd10_string_accuracy", rf"WITH c AS (SELECT doc_id, {_forms_sql(_EXACT)} AS c, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'z <answer>de </answer>' END AS s {_DOCS} SELECT doc_id, ({_PICK.format('c')} = {_PICK.format('s')})::INT::DOUBLE AS reward FROM c")
def _(s, d):
    solution = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("z <answer>de </answer>")
    return table(s, d, "documents").select("doc_id", R.string_accuracy(_forms(_EXACT), solution).alias("reward"))


@query("rwd11_code_format", rf"WITH c AS (SELECT doc_id, {_forms_sql(_CODE)} AS c, CASE WHEN doc_id % 3 = 0 THEN 'python' ELSE 'en' END AS l {_DOCS} SELECT doc_id, (regexp_full_match(c, '<think>.*?</think>\s*<answer>.*?</answer>\s*', 's') AND contains(c, '```' || l))::INT::DOUBLE AS reward FROM c")
def _(s, d):
    language = F.when(F.col("doc_id") % 3 == 0, "python").otherwise("en")
    return table(s, d, "documents").select("doc_id", R.code_format(_forms(_CODE), language).alias("reward"))


_ONE = "len(regexp_extract_all(c, '<{0}>')) = 1 AND len(regexp_extract_all(c, '</{0}>')) = 1"


@query("rwd12_tool_format", rf"""WITH c AS (SELECT doc_id, {_forms_sql(_TOOL)} AS c, doc_id // 7 % 4 AS k {_DOCS}
 SELECT doc_id, (CASE k WHEN 0 THEN regexp_full_match(c, '<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>', 's') AND {_ONE.format('tool_call')} AND {_ONE.format('response')}
   WHEN 1 THEN regexp_full_match(c, '<think>.*?</think>\n<response>.*?</response>', 's') AND {_ONE.format('response')} WHEN 2 THEN regexp_full_match(c, '<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>', 's') AND {_ONE.format('tool_call')}
   ELSE regexp_full_match(c, '<think>.*?</think>', 's') END)::INT::DOUBLE AS reward FROM c""")
def _(s, d):
    k = F.floor(F.col("doc_id") / 7) % 4
    solution = F.when(k == 0, "<tool_call>a</tool_call><response>b</response>").when(k == 1, "<response>b</response>").when(k == 2, "<tool_call>a</tool_call>").otherwise("plain")
    return table(s, d, "documents").select("doc_id", R.tool_format(_forms(_TOOL), solution).alias("reward"))


@query("rwd13_tool_length", r"SELECT doc_id, least(round(len(regexp_extract_all(text, '[^ \t\n\r\x0b\f]+')) / 512.0, 2), 1)::DOUBLE AS reward FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", R.tool_length(F.concat(F.lit("<think>"), "text", F.lit("</think>"))).alias("reward"))


def _call(name: Column, **values: Column) -> Column:
    """A tool call with number parameters."""
    args = [x for i, (k, v) in enumerate(values.items()) for x in (F.lit((", " if i else "") + f'"{k}": '), v.cast("string"))]
    return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "parameters": {'), *args, F.lit("}}\n</tool_call>"))


@query("rwd14_tool_correctness", """WITH n AS (SELECT event_id, user_id % 5 AS a, event_id % 5 AS b, event_id % 3 AS c, user_id % 3 AS d, event_type = 'click' AS same FROM events)
 SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0 WHEN same THEN (1 + 1 + (a = b)::INT + (c = d)::INT) / 4.0 ELSE 0 END, 6) AS reward FROM n""")
def _(s, d):
    """One call with two parameters: points for the name, the parameter names and each value; some rows hold no call."""
    have = _call(F.col("event_type"), x=F.col("user_id") % 5, y=F.col("event_id") % 3)
    have = F.when(F.col("event_id") % 11 == 0, "no call").otherwise(have)
    want = _call(F.lit("click"), x=F.col("event_id") % 5, y=F.col("user_id") % 3)
    return table(s, d, "events").select("event_id", r6(R.vectorised(R.tool_match)(have, want), "reward"))


@query("jon08_tool_assignment", """WITH n AS (SELECT event_id, user_id % 3 AS a, event_id % 3 AS b, event_id // 3 % 3 AS w, user_id // 3 % 3 AS v FROM events)
 SELECT event_id, round((1 + CASE WHEN a = w OR b = w THEN 2 ELSE 1 END + CASE WHEN (CASE WHEN a = w THEN b WHEN b = w THEN a ELSE b END) = v THEN 2 ELSE 1 END) / 5.0, 6) AS reward FROM n""")
def _(s, d):
    """Two calls of one tool: each wanted call takes the best that is left, the first of equals."""
    have = F.concat(_call(F.lit("f"), x=F.col("user_id") % 3), _call(F.lit("f"), x=F.col("event_id") % 3))
    want = F.concat(_call(F.lit("f"), x=F.floor(F.col("event_id") / 3) % 3), _call(F.lit("f"), x=F.floor(F.col("user_id") / 3) % 3))
    return table(s, d, "events").select("event_id", r6(R.vectorised(R.tool_match)(have, want), "reward"))


@query("rwd15_trajectory", "SELECT conv_id, turn, last(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reward FROM (SELECT *, length(text)::DOUBLE AS n FROM conversations)")
def _(s, d):
    """The last turn's reward for each fragment."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("n"))
    return c.join(c.groupBy("conv_id").agg(F.max_by("n", "turn").alias("reward")), "conv_id").select("conv_id", "turn", "reward")
