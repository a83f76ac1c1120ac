"""Global order without a task that sees all rows: against plain sorts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, ordered, packing


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_running_sums(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), r.randint(0, 5), r.randint(0, 9)) for k in range(800)] + [(900, "only", 1, 3)]
    df = spark.createDataFrame(rows, "id long, g string, o int, v int").repartition(9)
    whole = sorted(rows, key=lambda x: (x[2], x[0]))
    want, total = {}, 0
    for k, _, _, v in whole:
        want[k], total = total, total + v
    assert {x.id: x.s for x in ordered.running(df, F.col("v"), [F.col("o"), F.col("id")], "s").collect()} == want
    want, totals = {}, {}
    for k, g, _, v in whole:
        want[k] = totals.get(g, 0)
        totals[g] = want[k] + v
    got = ordered.running(df, F.col("v"), [F.col("o"), F.col("id")], "s", ["g"])
    assert {x.id: x.s for x in got.collect()} == want and set(got.columns) == {*df.columns, "s"}
    assert "SinglePartition" not in _plan(got)
    assert ordered.running(df.limit(0), F.col("v"), [F.col("id")], "s").count() == 0


def test_tie_ranks(spark):
    r = random.Random(4)
    xs = [r.choice([1.0, 2.0, 2.5, -3.0]) if r.random() < 0.7 else r.random() for _ in range(600)]
    got = {x.x: x.rank for x in ordered.tie_ranks(spark.createDataFrame([(x,) for x in xs], "x double"), "x").collect()}
    s = np.sort(xs)
    assert got == {x: (np.searchsorted(s, x, "left") + 1 + np.searchsorted(s, x, "right")) / 2 for x in set(xs)}


def test_spearman(spark):
    r = random.Random(5)
    rows = [(float(r.randint(0, 3)), r.random(), float(r.randint(0, 2))) for _ in range(400)]
    out = aggregates.pair_correlations(spark.createDataFrame(rows, "label double, s double, t double"), "label", ["s", "t"])
    a = np.array(rows)
    rank = lambda x: (np.searchsorted(np.sort(x), x, "left") + np.searchsorted(np.sort(x), x, "right")) / 2
    got = out.first()
    assert got.spearman_s == pytest.approx(np.corrcoef(rank(a[:, 0]), rank(a[:, 1]))[0, 1]) and got.spearman_t == pytest.approx(np.corrcoef(rank(a[:, 0]), rank(a[:, 2]))[0, 1])
    assert "Window" not in _plan(out)[:400]


@pytest.mark.parametrize("kind", ["even", "tied", "far", "two", "one"])
def test_selection(spark, kind):
    r = random.Random(6)
    make = {"even": lambda: r.random(), "tied": lambda: float(r.choice([0, 0, 0, 1, 2, 3])), "far": lambda: 10.0 ** r.uniform(-300, 300), "two": lambda: float(r.choice([1, 1, 7])), "one": lambda: 4.0}[kind]
    xs = [make() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").repartition(5)
    s = sorted(xs)
    for k in (0, 1, 166, 250, 333, 498):
        assert ordered.select(df, "x", (k, k + 1), bound=8) == (s[k], s[k + 1])
    assert ordered.quantile(df, "x", 0.8) == pytest.approx(np.quantile(xs, 0.8), rel=1e-12)
    assert ordered.quantile(df.where("x IS NULL"), "x", 0.5) is None and ordered.select(df, "x", (499, 500)) is None


def test_sequential_fill(spark):
    r = random.Random(8)
    rows = [(k, r.choice("xxxy"), r.randint(0, 30)) for k in range(500)]
    got = {x.id: (x["sample"], x.start, x.taken) for x in packing.sequential_fill(spark.createDataFrame(rows, "id long, g string, n long"), "id", "n", 64, F.md5(F.col("id").cast("string")), F.col("g")).collect()}
    import hashlib

    at = {}
    for k, g, n in sorted(rows, key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
        p = at.get(g, 0)
        at[g] = p + n + 1
        assert got[k] == (p // 64, p % 64, min(n, 64 - p % 64))
