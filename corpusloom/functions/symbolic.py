"""Equality of mathematical answers by randomised identity testing.

An answer in LaTeX or plain notation is parsed to a syntax tree. Two trees without roots, powers by variables or transcendental
parts are equal if they take the same values at random points of the prime field of 2^61 - 1 elements: of different rational
functions of degree d the test is fooled at odds of at most (d / 2^61)^2, under 2^-62 for the degrees allowed. Constants among them are
compared as fractions, exactly; where one is a decimal fraction, to 1e-9 of its size. Other trees are compared at three
complex points to 1e-9 of their size (a numerical test without a proof). Points are drawn from a fixed seed, so the result does not change.

An equation whose left side is one variable stands for its right side where the other answer has none; two equations are equal if
their differences of sides are in a constant ratio. Bare lists and braces are sets; brackets keep their order. Dropped: a percent sign, a degree
sign and \\text after a number (units). Words of three letters or more are names, shorter ones products of variables.
What can't be parsed is equal to the same text only. Nothing here raises, however long the text.
"""

from __future__ import annotations

import cmath
import random
import re
from fractions import Fraction

PRIME = (1 << 61) - 1
#: Degrees of rational functions, exponents, digits of a number, and characters that are still parsed.
MAX_DEGREE, MAX_POWER, MAX_DIGITS, MAX_TEXT = 1 << 30, 10_000, 4000, 20_000
TOLERANCE = 1e-9
FUNCTIONS = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh}
_TOKEN = re.compile(r"\s*(?:(\d+(?:,\d{3}(?!\d))*(?:\.\d+)?|\.\d+)|\\([A-Za-z]+)|([^\W\d_]+)|(.))", re.S)
_SPACING = re.compile(r"\\(?:left|right|displaystyle|quad|qquad)(?![A-Za-z])|\\[,!;: ]|\$")
_UNIT = re.compile(r"(?<=[\d}])\s*(?:\\(?:text|mathrm|mbox)\s*\{[^{}]*\}|\^\{?\\circ\}?|\\?%)")
_TEXT = re.compile(r"\\(?:text|mathrm|mbox|operatorname)\s*\{([^{}]*)\}")


class Unknown(ValueError):
    """No expression, or no value at a point."""


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, content): num, cmd, name or sign."""
    text = _TEXT.sub(r" \1 ", _UNIT.sub("", _SPACING.sub(" ", text.strip().rstrip("."))))
    out = []
    for m in _TOKEN.finditer(text.rstrip()):
        kind = m.lastindex
        out.append((("num", "cmd", "name", "sign")[kind - 1], m[kind]))
    return out


class Parser:
    """Recursive descent over tokens; trees are tuples of an operator and its operands."""

    def __init__(self, text: str) -> None:
        if len(text) > MAX_TEXT:
            raise Unknown(text[:40])
        self.t, self.k = tokens(text), 0

    def peek(self, *signs: str) -> bool:
        return self.k < len(self.t) and self.t[self.k][0] in ("sign", "cmd") and self.t[self.k][1] in signs

    def take(self, *signs: str) -> bool:
        if self.peek(*signs):
            self.k += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise Unknown(sign)

    def answer(self) -> tuple:
        """A whole answer: an expression, an equation, or a list of those."""
        out = [self.equation()]
        while self.take(",", ";"):
            out.append(self.equation())
        if self.k < len(self.t):
            raise Unknown(str(self.t[self.k]))
        return out[0] if len(out) == 1 else ("set", *out)

    def equation(self) -> tuple:
        left = self.sum()
        return ("=", left, self.sum()) if self.take("=") else left

    def sum(self) -> tuple:
        out = self.product()
        while self.peek("+", "-"):
            sign = self.t[self.k][1]
            self.k += 1
            out = (sign, out, self.product())
        return out

    def product(self) -> tuple:
        if self.take("-"):
            return ("-", ("num", Fraction(0)), self.product())
        if self.take("+"):
            return self.product()
        out = self.power()
        while self.k < len(self.t):
            if self.take("*", "cdot", "times", "·", "×"):
                out = ("*", out, self.signed())
            elif self.take("/", "div", "÷"):
                out = ("/", out, self.signed())
            elif self.starts():
                right = self.power()
                mixed = out[0] == "num" and right[0] == "/" and right[1][0] == right[2][0] == "num" and right[1][1] < right[2][1]
                out = ("+" if mixed else "*", out, right)
            else:
                break
        return out

    def signed(self) -> tuple:
        return ("-", ("num", Fraction(0)), self.signed()) if self.take("-") else self.power()

    def starts(self) -> bool:
        """Whether a factor begins here, without a sign before it; a number does not follow one."""
        kind, x = self.t[self.k]
        return kind == "name" or (kind == "cmd" and x not in ("cdot", "times", "div", "}")) or (kind == "sign" and x in "({[√π")

    def power(self) -> tuple:
        base = self.atom()
        while True:
            if self.take("^"):
                base = ("^", base, self.argument())
            elif self.take("!"):
                base = ("!", base)
            else:
                return base

    def argument(self) -> tuple:
        """What follows ^, \\frac or \\sqrt: a group, or one symbol or digit."""
        if self.take("{"):
            out = self.sum()
            self.need("}")
            return out
        if self.take("-"):
            return ("-", ("num", Fraction(0)), self.argument())
        kind, x = self.t[self.k] if self.k < len(self.t) else ("", "")
        if kind == "num" and len(x) > 1 and x.isdigit() and self.k and self.t[self.k - 1][1] != "^":
            self.t[self.k] = ("num", x[1:])  # \\frac12: one digit is taken
            return ("num", Fraction(int(x[0])))
        return self.atom()

    def bracket(self, close: str, kind: str) -> tuple:
        out = [self.equation()]
        while self.take(",", ";"):
            out.append(self.equation())
        if not self.peek(")", "]", "}") or (kind != "list" and not self.peek(close)):
            raise Unknown(close)
        end = self.t[self.k][1]
        self.k += 1
        if len(out) == 1 and kind != "set":
            return out[0]
        return ("set", *out) if kind == "set" else ("list" + end, *out)

    def atom(self) -> tuple:
        if self.k >= len(self.t):
            raise Unknown("end")
        kind, x = self.t[self.k]
        self.k += 1
        if kind == "num":
            x = x.replace(",", "")
            if len(x) > MAX_DIGITS:
                raise Unknown(x[:40])
            return ("dec" if "." in x else "num", Fraction(x))
        if kind == "name":
            if x.lower() in FUNCTIONS:
                return self.function(x.lower())
            if x == "sqrt":
                return ("^", self.atom(), ("num", Fraction(1, 2)))
            if x == "pi":
                return ("const", "pi")
            if len(x) > 2:
                return ("var", x)
            out = self.letter(x[0])
            if len(x) == 2:
                self.k -= 1
                self.t[self.k] = ("name", x[1])
            return self.index(out) if len(x) == 1 else out
        if kind == "sign":
            if x == "(":
                return self.bracket(")", "list")
            if x == "[":
                return ("first", self.bracket("]", "list"))
            if x == "{":
                out = self.sum()
                self.need("}")
                return out
            if x == "|":
                out = self.sum()
                self.need("|")
                return ("abs", out)
            if x == "π":
                return ("const", "pi")
            if x == "√":
                return ("^", self.atom(), ("num", Fraction(1, 2)))
            if x == "\\" and self.take("{"):
                out = [self.equation()]
                while self.take(",", ";"):
                    out.append(self.equation())
                self.need("\\")
                self.need("}")
                return ("set", *out)
            raise Unknown(x)
        if x in ("frac", "dfrac", "tfrac"):
            top = self.argument()
            return ("/", top, self.argument())
        if x == "sqrt":
            root = ("num", Fraction(2))
            if self.take("["):
                root = self.sum()
                self.need("]")
            return ("^", self.argument(), ("/", ("num", Fraction(1)), root))
        if x in FUNCTIONS:
            return self.function(x)
        if x == "pi":
            return ("const", "pi")
        if x in ("boxed", "mathbf", "mathbb"):
            return self.argument()
        if x in ("pm", "cup", "cap", "in", "le", "leq", "ge", "geq", "lt", "gt", "ne", "neq", "to", "int", "sum", "prod", "lim", "begin", "end"):
            raise Unknown(x)
        return self.index(("var", "\\" + x))

    @staticmethod
    def letter(x: str) -> tuple:
        return ("const", x) if x in ("e", "i") else ("var", x)

    def index(self, out: tuple) -> tuple:
        return ("var", f"{out[1]}_{self.argument()}") if self.take("_") else out

    def function(self, name: str) -> tuple:
        base = self.argument() if self.take("_") else None
        power = self.argument() if self.take("^") else None
        out = ("call", name, self.power())
        if base is not None:
            out = ("/", ("call", "ln", out[2]), ("call", "ln", base))
        return ("^", out, power) if power is not None else out


def parse(text: str) -> tuple | None:
    try:
        return Parser(text).answer()
    except (Unknown, RecursionError, ValueError, ZeroDivisionError):
        return None


def walk(tree: tuple) -> list[tuple]:
    """All nodes."""
    out, left = [], [tree]
    while left:
        node = left.pop()
        out.append(node)
        left += [x for x in node[1:] if isinstance(x, tuple)]
    return out


def exponent(tree: tuple) -> int:
    """A constant whole exponent within bounds."""
    value = in_field(tree, {}, None)
    if value.denominator != 1 or abs(value) > MAX_POWER:
        raise Unknown("exponent")
    return int(value)


def in_field(tree: tuple, env: dict[str, int], p: int | None) -> int | Fraction:
    """The value at a point of the field, or as a fraction (p None); Unknown for what is no rational function."""
    op = tree[0]
    if op in ("num", "dec"):
        x = tree[1]
        return x if p is None else x.numerator * pow(x.denominator, -1, p) % p
    if op == "var":
        if tree[1] not in env:
            raise Unknown(tree[1])
        return env[tree[1]]
    if op == "^":
        n, base = exponent(tree[2]), in_field(tree[1], env, p)
        if n < 0 and base == 0:
            raise ZeroDivisionError
        if p is None:
            if base and abs(n) * max(base.numerator.bit_length(), base.denominator.bit_length()) > 1 << 20:
                raise Unknown("large")
            return base**n
        return pow(base, n, p)
    if op == "!":
        n = exponent(tree[1])
        if not 0 <= n <= 1000:
            raise Unknown("factorial")
        out = 1
        for k in range(2, n + 1):
            out = out * k if p is None else out * k % p
        return Fraction(out) if p is None else out
    if op not in ("+", "-", "*", "/"):
        raise Unknown(op)
    a, b = in_field(tree[1], env, p), in_field(tree[2], env, p)
    if op == "/":
        if b == 0:
            raise ZeroDivisionError
        return a / b if p is None else a * pow(b, -1, p) % p
    out = a + b if op == "+" else a - b if op == "-" else a * b
    return out if p is None else out % p


def degree(tree: tuple) -> int:
    """A bound of the degrees of numerator and denominator."""
    op = tree[0]
    if op == "var":
        return 1
    if op == "^":
        return abs(exponent(tree[2])) * degree(tree[1])
    return sum(degree(x) for x in tree[1:] if isinstance(x, tuple)) if op != "!" else 0


def numeric(tree: tuple, env: dict[str, complex]) -> complex:
    op = tree[0]
    if op in ("num", "dec"):
        return complex(float(tree[1]))
    if op == "const":
        return {"pi": cmath.pi, "e": cmath.e, "i": 1j}[tree[1]]
    if op == "var":
        return env[tree[1]]
    if op == "call":
        return FUNCTIONS[tree[1]](numeric(tree[2], env))
    if op == "abs":
        return complex(abs(numeric(tree[1], env)))
    if op == "!":
        return complex(float(in_field(tree, {}, None)))
    if op not in ("+", "-", "*", "/", "^"):
        raise Unknown(op)
    a, b = numeric(tree[1], env), numeric(tree[2], env)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[op]()


_ERRORS = (Unknown, ValueError, OverflowError, ZeroDivisionError, RecursionError, KeyError)


def _values(trees: list[tuple], rounds: int = 2) -> list[list] | None:
    """Values of rational functions at random points of the field; None if one is none."""
    names = sorted({n[1] for t in trees for n in walk(t) if n[0] == "var"})
    draw, out = random.Random(20240521), []
    try:
        if sum(degree(t) for t in trees) > MAX_DEGREE:
            return None
        for _ in range(4 * rounds):
            try:
                point = {x: draw.randrange(1, PRIME) for x in names}
                out.append([in_field(t, point, PRIME) for t in trees])
            except ZeroDivisionError:
                continue
            if len(out) == rounds:
                return out
    except (Unknown, RecursionError, ValueError):
        return None
    return None


def _points(trees: list[tuple], rounds: int = 3) -> list[list[complex]]:
    """Values at random complex points where all are finite."""
    names = sorted({n[1] for t in trees for n in walk(t) if n[0] == "var"})
    draw, out = random.Random(20240522), []
    for _ in range(4 * rounds):
        point = {x: complex(draw.uniform(-2, 2), draw.uniform(-2, 2)) for x in names}
        try:
            values = [numeric(t, point) for t in trees]
        except _ERRORS:
            continue
        if all(cmath.isfinite(v) for v in values):
            out.append(values)
        if len(out) == rounds:
            break
    return out


def _near(a: complex, b: complex) -> bool:
    return abs(a - b) <= TOLERANCE * max(1.0, abs(a), abs(b))


def same_expression(a: tuple, b: tuple) -> bool:
    try:
        if not any(n[0] in ("var", "const") for t in (a, b) for n in walk(t)):
            x, y = in_field(a, {}, None), in_field(b, {}, None)
            decimal = any(n[0] == "dec" for t in (a, b) for n in walk(t))
            return abs(x - y) <= Fraction(1, 10**9) * max(1, abs(y)) if decimal else x == y
    except _ERRORS:
        pass  # roots and functions
    if (found := _values([a, b])) is not None:
        return all(x == y for x, y in found)
    found = _points([a, b])
    return bool(found) and all(_near(x, y) for x, y in found)


def same(a: tuple, b: tuple) -> bool:
    """Equality of two parsed answers."""
    many = lambda t: t[0] == "set" or t[0].startswith("list") or t[0] == "first"
    if a[0] == "=" and b[0] == "=":
        left, right = ("-", a[1], a[2]), ("-", b[1], b[2])
        if (found := _values([left, right])) is not None:
            (x, y), (u, v) = found
            return (x * v - u * y) % PRIME == 0 and (x == 0) == (y == 0)
        found = _points([left, right])
        return bool(found) and all(_near(x * found[0][1], y * found[0][0]) and (abs(x) < TOLERANCE) == (abs(y) < TOLERANCE) for x, y in found)
    for x, y in ((a, b), (b, a)):
        if x[0] == "=" and y[0] != "=":
            return x[1][0] == "var" and same(x[2], y)
    if many(a) or many(b):
        if a[0] != b[0] or len(a) != len(b):
            return False
        if a[0] != "set":
            return all(same(x, y) for x, y in zip(a[1:], b[1:], strict=True))
        free = list(b[1:])
        for x in a[1:]:
            k = next((k for k, y in enumerate(free) if same(x, y)), None)
            if k is None:
                return False
            del free[k]
        return True
    return same_expression(a, b)


def equal(a: str, b: str) -> bool:
    """Whether two answers are equal as expressions; False if either is none."""
    x, y = parse(a), parse(b)
    if x is None or y is None:
        return False
    try:
        return same(x, y)
    except _ERRORS:
        return False
