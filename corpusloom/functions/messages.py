"""Expressions over canonical messages: array<struct<role:string, content:string>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed set of roles.
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
MESSAGE = "struct<role:string,content:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def from_turns(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, messages) from one row per turn."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return rows.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def valid(messages: Column) -> Column:
    """Not empty, known roles, no null content."""
    return messages.isNotNull() & (F.size(messages) > 0) & F.coalesce(F.forall(messages, lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull()), F.lit(False))


def last(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))


def without_response(messages: Column) -> Column:
    """Messages without a trailing assistant turn."""
    return F.when(last(messages)["role"] == "assistant", F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def response(messages: Column) -> Column:
    """The trailing assistant turn's content, or null."""
    return F.when(last(messages)["role"] == "assistant", last(messages)["content"])


def with_response(messages: Column, content: Column) -> Column:
    """A trailing assistant turn replaced, or one added."""
    return F.concat(without_response(messages), F.array(message("assistant", content)))


def last_user_index(messages: Column) -> Column:
    """0-based index of the last user turn, -1 if none."""
    n = F.size(messages)
    back = F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "user")
    return F.when(back > 0, n - back).otherwise(F.lit(-1)).cast("long")


def rejected_messages(messages: Column, rejected: Column) -> Column:
    """Everything after the last user turn replaced by the rejected response."""
    return F.concat(F.slice(messages, 1, (last_user_index(messages) + 1).cast("int")), F.array(message("assistant", rejected)))


def valid_rejected(messages: Column, rejected: Column) -> Column:
    return F.coalesce(rejected.isNotNull() & (rejected != last(messages)["content"]), F.lit(False))


def from_history(history: Column, query: Column, response: Column, system: Column) -> Column:
    """Messages from [query, response] pairs and a last pair; turns with null content go."""
    pairs = F.concat(F.coalesce(history, F.array().cast("array<array<string>>")), F.array(F.array(query, response)))
    turns = F.flatten(F.transform(pairs, lambda p: F.array(message("user", F.get(p, 0)), message("assistant", F.get(p, 1)))))
    head = F.when(system.isNotNull(), F.array(message("system", system))).otherwise(F.array().cast(f"array<{MESSAGE}>"))
    return F.filter(F.concat(head, turns), lambda m: m["content"].isNotNull())


def to_history(messages: Column) -> Column:
    """struct(system, history): pairs of user and assistant contents; a missing half is null."""
    system = F.when(F.get(messages, 0)["role"] == "system", F.get(messages, 0)["content"])
    rest = F.filter(messages, lambda m: m["role"] != "system")
    count = F.ceil(F.size(rest) / 2).cast("int")
    pairs = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array(F.get(rest, i * 2)["content"], F.get(rest, i * 2 + 1)["content"]))).otherwise(F.array().cast("array<array<string>>"))
    return F.struct(system.alias("system"), pairs.alias("history"))


def merged(messages: Column, joiner: str = "\n", roles: tuple[str, ...] = ("user", "assistant")) -> Column:
    """Consecutive turns of one role (of `roles`) joined into one."""
    def step(out: Column, m: Column) -> Column:
        top = F.try_element_at(out, F.lit(-1))
        same = (F.size(out) > 0) & (top["role"] == m["role"]) & m["role"].isin(*roles)
        both = F.struct(m["role"].alias("role"), F.concat(top["content"], F.lit(joiner), m["content"]).alias("content"))
        one = F.struct(m["role"].alias("role"), m["content"].alias("content"))
        return F.when(same, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(one)))

    return F.aggregate(messages, F.array().cast(f"array<{MESSAGE}>"), step)


def tool_runs(messages: Column, joiner: str = "\n") -> Column:
    """Runs of tool_call turns become one assistant turn."""
    as_assistant = merged(messages, joiner, ("tool_call",))
    return F.transform(as_assistant, lambda m: F.struct(F.when(m["role"] == "tool_call", "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def render(messages: Column, prefix: Column | None = None, user: tuple[str, str] = ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), suffix: str = "<|im_end|>\n", system: tuple[str, str] = ("<|im_start|>system\n", "<|im_end|>\n"), default_system: str | None = None) -> Column:
    """ChatML text: system, then rounds; a trailing user turn ends with the prompt for an answer."""
    parts = F.transform(
        messages,
        lambda m: F.when(m["role"] == "system", F.concat(F.lit(system[0]), m["content"], F.lit(system[1])))
        .when(m["role"].isin("user", "tool", "tool_response"), F.concat(F.lit(user[0]), m["content"], F.lit(user[1])))
        .otherwise(F.concat(m["content"], F.lit(suffix))),
    )
    text = F.array_join(parts, "")
    if default_system is not None:
        has = F.coalesce(F.get(messages, 0)["role"] == "system", F.lit(False))
        text = F.when(has, text).otherwise(F.concat(F.lit(system[0] + default_system + system[1]), text))
    return F.concat(prefix, text) if prefix is not None else text


def strip_thinking(content: Column) -> Column:
    """What follows the last </think>, trimmed."""
    return F.regexp_replace(F.try_element_at(F.split(content, "</think>"), F.lit(-1)), r"(?U)\A\s+|\s+\z", "")


def strip_history_thinking(messages: Column) -> Column:
    """Thinking is removed from assistant turns before the last user turn."""
    at = last_user_index(messages)
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when((m["role"] == "assistant") & (i < at), strip_thinking(m["content"])).otherwise(m["content"]).alias("content")))


def loss_scales(messages: Column, strategy: str = "default") -> Column:
    """One weight per turn. default: assistant turns; last_round: those after the last user turn; all: every turn."""
    if strategy == "all":
        return F.transform(messages, lambda m: F.lit(1.0))
    at = last_user_index(messages)
    on = lambda m, i: (m["role"] == "assistant") & (i > at) if strategy == "last_round" else m["role"] == "assistant"
    return F.transform(messages, lambda m, i: F.when(on(m, i), 1.0).otherwise(0.0))


def query_text(messages: Column) -> Column:
    """'Role: content' lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")
