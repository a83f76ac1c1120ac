"""Answers compared as expressions, and rewards that never raise."""

import json
import random

import pytest

from corpusloom.functions import rewards as R
from corpusloom.functions import symbolic as S

EQUAL = [
    ("x = 5", "5"), (r"\sqrt{4}", "2"), (r"\frac12", "1/2"), (r"\frac{1}{2}", "0.5"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{x^2-1}{x-1}", "x+1"), (r"2\pi r", r"r \cdot 2 \pi"),
    (r"\sqrt{8}", r"2\sqrt{2}"), (r"\sin^2 x+\cos^2 x", "1"), ("1,000", "1000"), (r"5\text{ cm}", "5"), (r"90^\circ", "90"), ("50%", "50"), ("(1,2)", r"\left(1, 2\right)"),
    (r"\{1,2\}", r"\{2,1\}"), ("1, 2", "2, 1"), ("y=2x+1", "2x-y+1=0"), (r"1\frac{1}{2}", "3/2"), ("x*y", "yx"), ("3!", "6"), (r"\log_{2} 8", "3"), ("a/b/c", "a/(bc)"), (r"e^{\ln 5}", "5"), ("1/(1/x)", "x"),
    ("x^{-1}", r"\frac{1}{x}"), ("[0, 1)", "[0,1)"), ("1" * 400, "1" * 400), ("\\boxed{7}", "7"),
]
DIFFERENT = [
    ("x=5", "6"), (r"\sqrt{4}", "3"), ("(1,2)", "(2,1)"), ("[0,1]", "[0,1)"), ("[0,1]", "(0,1]"), ("(x+1)^2", "x^2+1"), ("yes", "sey"), ("5", "1" * 400), ("y=2x+1", "y=2x"), ("x", "y"),
    (r"\{1,2\}", r"\{1,3\}"), ("1,2", "1,2,3"), ("", ""), ("\\", "\\frac"), ("1/0", "2/0"), ("x^2", "x^3"), ("1" * 5000, "2" * 5000), ("9" * 400 + "/7", "1"), ("10^{20}+1", "10^{20}"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert R.math_equal(a, b) and R.math_equal(b, a)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert not R.math_equal(a, b) and not R.math_equal(b, a)


def test_gold_completions():
    text = "Let me solve step by step:\n1. First we have x = 2\n2. Then y = 3x = 6\n3. Finally z = x + y = 8\n\nFinal answer: \\boxed{8}"
    assert R.math_accuracy(text, "\\boxed{8}") == 1 and R.math_accuracy("After careful calculation, the final answer is \\boxed{100}", "\\boxed{100}") == 1
    assert R.math_accuracy("The answer is \\boxed{42}", "\\boxed{100}") == 0


def _grown(r, tree):
    """A tree of the same value in another form."""
    op = r.randrange(6)
    if op == 0:
        return f"({tree} + {(k := r.randint(1, 9))}) - {k}"
    if op == 1:
        return f"\\frac{{{(k := r.randint(2, 9))} \\cdot ({tree})}}{{{k}}}"
    if op == 2:
        return f"(x + 1)({tree}) - x \\cdot ({tree})"
    if op == 3:
        return f"-(-({tree}))"
    if op == 4:
        return f"\\frac{{(y^2 + 1)({tree})}}{{y^2 + 1}}"
    return f"(({tree}) + z^2)-z^{{2}}"


def test_generated_pairs():
    r = random.Random(7)
    for _ in range(150):
        terms = [f"{r.randint(1, 9)} {v}^{{{r.randint(0, 4)}}}" for v in r.sample("xyz", r.randint(1, 3))]
        base = " + ".join(terms)
        other = base
        for _ in range(r.randint(1, 4)):
            other = _grown(r, other)
        assert S.equal(base, other), (base, other)
        assert not S.equal(base, f"{other} + {r.randint(1, 9)}") and not S.equal(base, f"({other}) \\cdot x")


def test_no_text_raises():
    r = random.Random(3)
    signs = list("0123456789+-*/^_{}()[]|,;=!.%$\\ xyeiπ√") + ["\\frac", "\\sqrt", "\\sin", "\\left(", "\\text{cm}", "\\{", "\\}", "\\pm", "1" * 50]
    for _ in range(3000):
        a, b = ("".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(2))
        assert R.math_accuracy(f"\\boxed{{{a}}}", b) in (0.0, 1.0)
        assert S.parse(a) is None or S.equal(a, a) in (True, False)
    for long in ("9" * 100_000, "(" * 50_000 + "1" + ")" * 50_000, "2^" * 3000 + "2", "1/" * 20_000 + "3", "\\frac" * 5000, "x^{9999}" * 500):
        assert R.math_accuracy(f"\\boxed{{{long}}}", "7") == 0.0
        assert R.countdown(f"<answer>{long}</answer>", '{"nums": [1], "target": 1}') == 0.0


def _any_json(r, depth=3):
    kind = r.randrange(7 if depth else 5)
    if kind == 5:
        return [_any_json(r, depth - 1) for _ in range(r.randint(0, 3))]
    if kind == 6:
        return {r.choice(["name", "parameters", "arguments", "x"]): _any_json(r, depth - 1) for _ in range(r.randint(0, 3))}
    return [None, True, r.randint(-5, 5), 1e300 * 10, "text"][kind]


def test_tool_match_takes_any_json():
    r = random.Random(11)
    call = lambda: f"<tool_call>\n{json.dumps(_any_json(r))}\n{{\"name\": {json.dumps(_any_json(r, 1))}, \"parameters\": {json.dumps(_any_json(r))}}}\n{{bad\n</tool_call>"
    for _ in range(2000):
        assert 0 <= R.tool_match(call(), call()) <= 1
    one = '<tool_call>\n{"name": "f", "parameters": [1]}\n</tool_call>'
    assert R.tool_match(one, one) == 1 and R.tool_match(one, one.replace("[1]", '"x"')) == pytest.approx(2 / 3)
    assert R.tool_match(one, None) == 0 and R.tool_match(None, "") == 1
