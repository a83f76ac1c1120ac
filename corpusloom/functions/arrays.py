"""Expressions over token, label and log-probability arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression inside a lambda is otherwise computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(ids: Column, needle: Column) -> Column:
    """0-based starts of a sub-sequence."""
    return bound(ids, lambda x: F.filter(_range(F.size(x) - F.size(needle) + 1), lambda i: F.slice(x, i + 1, F.size(needle)) == needle))


def pad(ids: Column, length: Column, value: Column, left: bool = False) -> Column:
    fill = F.array_repeat(value, F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def one_hot(labels: Column, n: int) -> Column:
    return F.transform(_range(F.lit(n)), lambda i: F.array_contains(labels.cast("array<int>"), i).cast("double"))


def zigzag(ids: Column, rank: int, world: int) -> Column:
    """Chunks rank and 2 * world - 1 - rank of 2 * world equal chunks."""
    size = (F.size(ids) / (2 * world)).cast("int")
    return F.concat(F.slice(ids, size * rank + 1, size), F.slice(ids, size * (2 * world - 1 - rank) + 1, size))


def top_logprobs(logprobs: Column, n: int) -> Column:
    """The n best of map<token, logprob> as [(token, logprob)], without -inf."""
    finite = F.filter(F.map_entries(logprobs), lambda e: e["value"] > F.lit(float("-inf")))
    best = F.slice(F.array_sort(F.transform(finite, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("token")))), 1, n)
    return F.transform(best, lambda s: F.struct(s["token"].alias("token"), (-s["neg"]).alias("logprob")))


def replace_assistant(roles: Column, contents: Column, rounds: Column) -> Column:
    """Contents with the last assistant turns replaced by rounds, the last round to the last turn."""
    def replaced(at: Column) -> Column:
        shift = F.size(rounds) - F.size(at)
        return F.transform(contents, lambda c, i: F.coalesce(F.when(F.get(roles, i) == "assistant", F.get(rounds, (F.array_position(at, i) - 1).cast("int") + shift)), c))

    return bound(F.filter(_range(F.size(roles)), lambda i: F.get(roles, i) == "assistant"), replaced)


def argmax(x: Column) -> Column:
    """0-based, the first of ties."""
    return F.array_position(x, F.array_max(x)) - 1


def sigmoid_labels(x: Column, cut: float = 0.5) -> Column:
    """Indices whose sigmoid reaches the cut."""
    return F.filter(_range(F.size(x)), lambda i: 1 / (1 + F.exp(-F.get(x, i))) >= cut)


def class_logprobs(x: Column, n: int) -> Column:
    """The n best classes as [(class, logprob)]."""
    lse = bound(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))
    ranked = F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("neg"), i.alias("cls")))), 1, n)
    return bound(lse, lambda z: F.transform(ranked, lambda s: F.struct(s["cls"].alias("cls"), (-s["neg"] - z).alias("logprob"))))
