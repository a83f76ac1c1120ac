"""Rewards as expressions of completion and solution; those with real parsing are Arrow-batched UDFs."""

from __future__ import annotations

import ast
import json
import math
import operator
import re
from collections import Counter
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import symbolic
from corpusloom.functions import text as T
from corpusloom.functions.arrays import bound
from corpusloom.operators.aggregates import gram_hashes, hashed_words

_one = lambda c: F.when(c, 1.0).otherwise(0.0)

#: Formats of whole completions.
THINK_ANSWER = r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"
REACT = r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$"


def format_reward(completion: Column) -> Column:
    return _one(completion.rlike(THINK_ANSWER))


def react_format(completion: Column) -> Column:
    return _one(completion.rlike(REACT))


def cosine_length(length: Column, correct: Column, max_len: int = 1000, wrong: tuple[float, float] = (-0.5, 0.0), right: tuple[float, float] = (1.0, 0.5)) -> Column:
    """(value at length 0, value at max_len) for wrong and right completions, joined by a half cosine; not clamped beyond."""
    start, end = F.when(correct, right[0]).otherwise(wrong[0]), F.when(correct, right[1]).otherwise(wrong[1])
    return start - (start - end) * (1 - F.cos(length * math.pi / max_len)) / 2


def repetition(completion: Column, n: int = 3, penalty: float = -1.0) -> Column:
    """penalty times the share of repeated word n-grams (hashed to 64 bits)."""
    grams = bound(hashed_words(T.words(F.lower(completion))), lambda h: gram_hashes(h, n))
    return F.coalesce(bound(grams, lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * penalty)), F.lit(0.0))


def soft_overlong(length: Column, max_length: int, cache: int) -> Column:
    return F.least(-(length - (max_length - cache)) / cache, F.lit(0.0))


def string_accuracy(completion: Column, solution: Column) -> Column:
    """Equality of <answer> contents, or of the whole texts where there are none."""
    pick = lambda c: F.when(c.rlike(r"(?s)<answer>.*?</answer>"), T.answer_tag(c)).otherwise(F.trim(c))
    return _one(pick(completion) == pick(solution))


def code_format(completion: Column, language: Column) -> Column:
    return _one(completion.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\s*\z") & F.contains(completion, F.concat(F.lit("```"), language)))


def tool_length(completion: Column, full: int = 512) -> Column:
    """Words of <think> over `full`, two digits, at most 1."""
    think = F.regexp_extract(completion, r"(?s)<think>(.*?)</think>", 1)
    return F.least(F.round(F.size(T.words(think)) / full, 2), F.lit(1.0))


def tool_format(completion: Column, solution: Column) -> Column:
    """The tags of the completion must be those of the solution: think, then tool_call, response, both or neither."""
    one = lambda t, n=1: (F.size(F.regexp_extract_all(completion, F.lit(f"<{t}>"), F.lit(0))) == n) & (F.size(F.regexp_extract_all(completion, F.lit(f"</{t}>"), F.lit(0))) == n)
    call, reply = solution.contains("<tool_call>"), solution.contains("<response>")
    think = r"(?s)\A<think>.*?</think>"
    return _one(
        F.when(call & reply, completion.rlike(think + r"\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>\z") & one("tool_call") & one("response"))
        .when(reply, completion.rlike(think + r"\n<response>.*?</response>\z") & one("response"))
        .when(call, completion.rlike(think + r"\n<tool_call>\n.*?\n</tool_call>\z") & one("tool_call"))
        .otherwise(completion.rlike(think + r"\z"))
    )


def vectorised(f: Callable[[str | None, str | None], float]) -> Callable[[Column, Column], Column]:
    """A pandas UDF of a scalar function of completion and solution."""
    def run(completion: pd.Series, solution: pd.Series) -> pd.Series:
        return pd.Series([f(c, s) for c, s in zip(completion, solution, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(expression: str) -> Fraction:
    """Exact value of numbers with + - * / and brackets; ValueError for anything else."""
    def value(node: ast.AST) -> Fraction:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return Fraction(repr(node.value)) if math.isfinite(node.value) else value(ast.Name())
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(expression)

    try:
        return value(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, ZeroDivisionError, RecursionError, MemoryError, OverflowError) as e:
        raise ValueError(expression) from e


def countdown(completion: str | None, task: str | None) -> float:
    """task: JSON with target and nums. 1 if the answer's equation uses each number once and meets the target; 0 for a task that is none."""
    found = re.search(r"<answer>(.*?)</answer>", completion or "", re.S)
    if not found:
        return 0.0
    equation = found[1].strip().split("=")[0]
    try:
        given = json.loads(task or "")
        if sorted(map(int, re.findall(r"\d+", equation))) != sorted(given["nums"]):
            return 0.0
        return float(abs(arithmetic(equation) - Fraction(given["target"])) < Fraction(1, 100_000))
    except (ValueError, TypeError, KeyError, OverflowError, RecursionError):
        return 0.0


def _plain(x: str) -> str:
    """An answer without LaTeX dress: boxes, dollar signs, \\text, thousands separators, spaces."""
    x = re.sub(r"\\(?:left|right|,|!|;|displaystyle)", "", x.strip().strip("$").rstrip("."))
    x = re.sub(r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", r"\1", x)
    x = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", x)
    return re.sub(r"(?<=\d),(?=\d{3})", "", x).replace("\\%", "").replace("%", "").replace(" ", "")


def math_equal(a: str, b: str) -> bool:
    """Equal as plain strings (without percent signs and other dress) or as expressions (functions/symbolic.py)."""
    x, y = _plain(a), _plain(b)
    return x == y != "" or symbolic.equal(a, b)


def last_boxed(text: str) -> str | None:
    """The content of the last \\boxed{...}, braces counted."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[at + 7 : i]
    return None


def math_accuracy(completion: str | None, solution: str | None) -> float:
    """Boxed or tagged answers compared; a completion without one is read from its last number."""
    def answer(t: str) -> str:
        tag = re.search(r"<answer>(.*?)</answer>", t, re.S)
        t = tag[1] if tag else t
        box = last_boxed(t)
        return box if box is not None else t.strip()

    c, s = answer(completion or ""), answer(solution or "")
    if math_equal(c, s):
        return 1.0
    numbers = re.findall(r"-?\d+(?:\.\d+)?", c)
    return float(bool(numbers) and last_boxed(completion or "") is None and math_equal(numbers[-1], s))


def _tool_calls(text: str | None) -> list[tuple[str, dict]]:
    """(name, parameters) of the lines in <tool_call> blocks that are JSON objects with a name."""
    out = []
    for block in re.findall(r"<tool_call>(.*?)</tool_call>", text or "", re.S):
        for line in block.strip().splitlines():
            try:
                got = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if isinstance(got, dict) and "name" in got:
                given = got.get("parameters", got.get("arguments"))
                out.append((str(got["name"]), given if isinstance(given, dict) else {} if given is None else {"": given}))
    return out


def tool_match(completion: str | None, solution: str | None) -> float:
    """Overlap of tool calls in [0, 1]: names as multisets, then each wanted call with its best unused match by
    parameter names and values. Parameters that are no object (a list, a text) count as one value without a name."""
    have, want = _tool_calls(completion), _tool_calls(solution)
    if not want or not have:
        return float(have == want)
    names = [Counter(name for name, _ in x) for x in (have, want)]
    score, most = sum((names[0] & names[1]).values()) / sum((names[0] | names[1]).values()), 1.0
    free = list(have)
    for name, wanted in want:
        most += 1 + len(wanted)

        def gain(call: tuple[str, dict], wanted: dict = wanted) -> float:
            given = call[1]
            keys = len(set(given) | set(wanted))
            return (len(set(given) & set(wanted)) / keys if keys else 1.0) + sum(given.get(k, object()) == v for k, v in wanted.items())

        same = [k for k, call in enumerate(free) if call[0] == name]
        if same:
            best = max(same, key=lambda k: gain(free[k]))
            score += gain(free.pop(best))
    return score / most


def react_score(completion: Column, solution: Column) -> Column:
    """1 if action and JSON input keys and values match those of the solution; text inputs must be equal."""
    name = lambda t: F.trim(F.regexp_extract(t, r"(?s).*Action:(.*?)(?:\n|\z)", 1))
    args = lambda t: F.trim(F.regexp_extract(t, r"(?s).*Action Input:(.*?)(?:\nObservation:|\z)", 1))
    same_json = F.coalesce(F.from_json(args(completion), "map<string,string>") .isNotNull() & (F.array_sort(F.map_entries(F.from_json(args(completion), "map<string,string>"))) == F.array_sort(F.map_entries(F.from_json(args(solution), "map<string,string>")))), F.lit(False))
    return _one((name(completion) == name(solution)) & (same_json | (args(completion) == args(solution))))
