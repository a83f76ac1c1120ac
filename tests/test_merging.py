"""Means on the sphere, matched units, event files, concurrent rewards, streams and cluster drivers against plain versions."""

import asyncio
import glob
import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assignment, clustering, concurrent, experts, manifold, normalise
from corpusloom.plans import catalogue
from corpusloom.sources import scalars

DATA = "/root/testdata/sf0.001"


def karcher(v, w, rounds=10, tol=1e-5):
    if len(v) == 1:
        return v[0], 0
    n = np.linalg.norm(v, axis=1)
    ok = n > tol
    if not ok.any():
        return np.zeros(v.shape[1]), 0
    u, a = v[ok] / n[ok, None], w[ok] / w[ok].sum()
    m = a @ u
    m = u[0] if np.linalg.norm(m) < tol else m / np.linalg.norm(m)
    steps = 0
    for _ in range(rounds):
        d = np.clip(u @ m, -1, 1)
        t = np.arccos(d)
        c = np.where(t < tol, 0, a * t / np.where(t < tol, 1, np.sin(t)))
        g = (c[:, None] * (u - d[:, None] * m)).sum(0)
        size = np.linalg.norm(g)
        if size < tol:
            break
        m = np.cos(size) * m + np.sin(size) * g / size
        m, steps = m / np.linalg.norm(m), steps + 1
    return (w * n).sum() * m, steps


def test_karcher_mean_of_labels(spark):
    pdf = spark.read.parquet(DATA + "/embeddings.parquet").toPandas()
    got = {r.label: r for r in manifold.karcher_mean(spark.createDataFrame(pdf), "label", "vec_id", "embedding", F.col("vec_id") % 5 + 1).collect()}
    for label, part in pdf.sort_values("vec_id").groupby("label"):
        want, steps = karcher(np.stack(part["embedding"]).astype(float), (part["vec_id"] % 5 + 1).to_numpy(float))
        np.testing.assert_allclose(got[label].merged, want, rtol=1e-6, atol=1e-6 * np.abs(want).max())
        assert got[label].rounds == steps <= 10


def test_karcher_mean_of_odd_groups(spark):
    rows = [(1, 1, [3.0, 4.0]), (2, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0]), (3, 1, [1.0, 0.0]), (3, 2, [-1.0, 0.0]), (4, 1, [2.0, 0.0]), (4, 2, [0.0, 0.0]), (4, 3, [0.0, 2.0]), (5, 1, None), (6, 1, [1.0, 1.0]), (6, 2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "label long, id long, v array<double>")
    got = {r.label: r for r in manifold.karcher_mean(df, "label", "id", "v", F.lit(1.0)).collect()}
    assert got[1].merged == [3.0, 4.0] and got[2].merged == [0.0, 0.0] and 5 not in got
    for k in (3, 4, 6):
        want, _ = karcher(np.array([v for label, _, v in rows if label == k]), np.ones(sum(label == k for label, *_ in rows)))
        np.testing.assert_allclose(got[k].merged, want, atol=1e-9)
    assert manifold.karcher_mean(df.where("v IS NULL"), "label", "id", "v", F.lit(1.0)).count() == 0
    slerp = {r.label: r.merged for r in manifold.multi_slerp(df, "label", "id", "v", F.lit(1.0)).collect()}
    assert slerp[1] == [3.0, 4.0] and slerp[3] == [0.0, 0.0] and slerp[6] == pytest.approx([1.5, 1.5], rel=1e-6)


def test_assignment_against_all_permutations():
    r = np.random.default_rng(3)
    for n in range(1, 9):
        for kind in range(3):
            cost = [r.random((n, n)), r.integers(0, 3, (n, n)).astype(float), r.normal(size=(n, n)) * 100][kind]
            got = assignment.assign(cost)
            assert sorted(got) == list(range(n))
            best = min(cost[range(n), p].sum() for p in map(list, itertools.permutations(range(n)))) if n < 8 or kind == 0 else None
            assert best is None or cost[range(n), got].sum() == pytest.approx(best)
    wide = r.random((3, 7))
    got = assignment.assign(wide)
    assert wide[range(3), got].sum() == pytest.approx(min(wide[range(3), list(p)].sum() for p in itertools.permutations(range(7), 3)))
    with pytest.raises(ValueError, match="more rows"):
        assignment.assign(wide.T)


def test_permuted_units_are_found(spark):
    r = np.random.default_rng(4)
    base, rows = r.normal(size=(6, 33)), []
    orders = {1: r.permutation(6), 2: r.permutation(6)}
    for layer in (0, 1):
        rows += [(layer, 0, u, base[u].tolist()) for u in range(6)]
        rows += [(layer, e, u, (base[o[u]] + 0.01 * r.normal(size=33)).tolist()) for e, o in orders.items() for u in range(6)]
    units = spark.createDataFrame(rows, "layer long, expert long, unit long, v array<double>")
    costs = assignment.unit_costs(units, "layer", "expert", "unit", "v", units.where("expert = 0").select("layer", "expert").distinct())
    got = assignment.permute_units(costs, "layer", "expert").collect()
    assert len(got) == 24 and all(r.matched == orders[r.expert][r.unit] for r in got)
    far = {(c.layer, c.expert, c.i, c.j): c.cost for c in costs.collect()}
    assert far[0, 1, 2, 3] == pytest.approx(np.abs(np.array(rows[6 + 2][3]) - base[3]).sum())


def test_event_files(spark, tmp_path):
    spark.dataSource.register(scalars.ScalarEvents)
    path = str(tmp_path / "run")
    rows = [("loss", k, float(np.float32(1 / (k + 10))), 1e9 + k) for k in range(-3, 500)] + [("größe/acc", 2**40, -1.5, 0.0), ("", 0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "tag string, step long, value float, wall_time double").withColumn("file", F.lit("")).repartition(3)
    df.write.format("scalars").mode("append").save(path)
    back = spark.read.format("scalars").load(path)
    assert sorted((r.tag, r.step, r.value, r.wall_time) for r in back.collect()) == sorted(rows) and back.select("file").distinct().count() == 3 == back.rdd.getNumPartitions()
    assert spark.read.format("scalars").schema("step long").load(path).columns == ["step"]
    assert spark.read.format("scalars").schema("value float, step long").load(path).agg(F.sum("step")).first()[0] == sum(r[1] for r in rows)
    one = max(glob.glob(path + "/events.*"), key=lambda f: len(open(f, "rb").read()))
    data = bytearray(open(one, "rb").read())
    for at in (3, 9, 14, len(data) - 2, 40):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="checksum|ends early"):
            scalars.records(bytes(broken), "f")
    with pytest.raises(ValueError, match="ends early|checksum"):
        scalars.records(bytes(data[:-1]))
    open(one, "wb").write(broken)
    with pytest.raises(Exception, match="checksum|ends early"):
        spark.read.format("scalars").load(path).collect()
    df.limit(1).write.format("scalars").mode("overwrite").save(path)
    assert spark.read.format("scalars").load(path).count() == 1


def test_masked_checksums_are_the_known_ones():
    data = np.frombuffer(b"123456789" + bytes(32), np.uint8)
    got = scalars.masked_crcs(data, np.array([0, 9, 3]), np.array([9, 32, 0]))
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert got.tolist() == [mask(0xE3069283), mask(0x8A9136AA), mask(0)]


def test_calls_are_in_flight_together():
    async def slow(row):
        await asyncio.sleep(0.1)
        if row["k"] == 3:
            raise ConnectionError
        return await asyncio.sleep(5) if row["k"] == 4 else row["k"]

    rows = [{"k": k} for k in range(12)]
    start = time.monotonic()
    got = asyncio.run(concurrent.gather(slow, rows, 12, 0.5, -1.0))
    assert got == [0, 1, 2, -1, -1, *range(5, 12)] and time.monotonic() - start < 0.5 * 12 * 0.1 + 0.5
    active, most = 0, 0

    async def counted(row):
        nonlocal active, most
        active += 1
        most = max(most, active)
        await asyncio.sleep(0.01)
        active -= 1

    assert asyncio.run(concurrent.gather(counted, rows, 4, 1.0, None)) == [None] * 12 and most == 4


def test_concurrent_rewards_keep_rows(spark):
    async def score(row):
        await asyncio.sleep(0.001 * (row["a"] % 3))
        return None if row["a"] is None else row["a"] * 2

    df = spark.createDataFrame([(k, k if k % 5 else None, f"s{k}") for k in range(50)], "id long, a long, s string")
    out = concurrent.concurrent_rewards(df, ["a"], score, "r", limit=8)
    assert out.columns == ["id", "a", "s", "r"] and {(r.id, r.r) for r in out.collect()} == {(k, 2.0 * k if k % 5 else None) for k in range(50)}
    assert concurrent.concurrent_rewards(df.limit(0), ["a"], score).count() == 0


def test_grounding_shares(spark):
    x = normalise.grounding_prompt(spark.range(20_000).withColumnRenamed("id", "k"), "k", {"en": [("a", "A"), ("b", "B")], "zh": [("c", "C")]})
    n = {(r["query"], r["response"]): r["count"] for r in x.groupBy("query", "response").count().collect()}
    assert set(n) == {("a", "A"), ("b", "B"), ("c", "C")} and abs(n["c", "C"] - 4000) < 300 and abs(n["a", "A"] - n["b", "B"]) < 400


def plain_average_linkage(d, k):
    """Clusters as sets; a merge is of the least mean distance between members."""
    groups, heights = [[i] for i in range(len(d))], []
    while len(groups) > k:
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda q: d[np.ix_(groups[q[0]], groups[q[1]])].mean())
        heights.append(d[np.ix_(groups[a], groups[b])].mean())
        groups[b] = groups[b] + groups.pop(a)
    return {frozenset(g) for g in groups}, heights


def as_sets(rows, layer, names):
    out = {}
    for r in rows:
        if r.layer == layer:
            out.setdefault(r.cluster, set()).add(names.index(r.expert))
    return {frozenset(g) for g in out.values()}


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(12)
    return {y: r.normal(size=(9 - y, 4)) for y in (0, 1, 2)}


def distance_rows(spark, matrices):
    return spark.createDataFrame([(y, i, j, float(d[i, j])) for y, d in matrices.items() for i in range(len(d)) for j in range(len(d)) if i != j], "layer long, i int, j int, distance double")


def test_penalised_clustering(spark, points):
    d = {y: np.linalg.norm(x[:, None] - x, axis=2) for y, x in points.items()}
    p = {y: np.random.default_rng(y).dirichlet(np.ones(len(x))) for y, x in points.items()}
    scaled = {y: d[y] * (1 + p[y][:, None] + p[y]) for y in d}
    got = clustering.agglomerative(distance_rows(spark, scaled), "layer", 4).collect()
    for y, m in scaled.items():
        assert as_sets(got, y, list(range(len(m)))) == plain_average_linkage(m, 4)[0]


@pytest.mark.parametrize("merges", [0, 5, 11, 21])
def test_multi_layer_merges(spark, points, merges):
    d = {y: np.linalg.norm(x[:, None] - x, axis=2) for y, x in points.items()}
    steps = sorted((max(h[: k + 1]), y, k) for y, m in d.items() for h in [plain_average_linkage(m, 1)[1]] for k in range(len(h)))
    share = {y: sum(s[1] == y for s in steps[:merges]) for y in d}
    got = clustering.multi_layer(distance_rows(spark, d), "layer", merges).collect()
    for y, m in d.items():
        assert as_sets(got, y, list(range(len(m)))) == plain_average_linkage(m, len(m) - share[y])[0]


def test_multi_layer_kmeans(spark, points):
    df = spark.createDataFrame([(y, i, x[i].tolist()) for y, x in points.items() for i in range(len(x))], "layer long, expert int, v array<double>")
    costs = {(r.layer, r.k): r.cost for r in clustering.kmeans_costs(df, "layer", "expert", "v").collect()}
    for y, x in points.items():
        assert costs[y, 1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and costs[y, len(x)] == pytest.approx(0, abs=1e-9)
    rises = []
    for y, x in points.items():
        top = 0.0
        for step, k in enumerate(range(len(x), 1, -1)):
            top = max(top, costs[y, k - 1] - costs[y, k])
            rises.append((top, y, step))
    share = {y: sum(s[1] == y for s in sorted(rises)[:8]) for y in points}
    got = clustering.multi_layer_kmeans(df, "layer", "expert", "v", 8).collect()
    for y, x in points.items():
        want = clustering.lloyd(x, len(x) - share[y])[0]
        assert {r.expert: r.cluster for r in got if r.layer == y} == dict(enumerate(want.tolist()))
        label, cost = clustering.lloyd(x, 3)
        assert cost == pytest.approx(sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in range(3)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_cluster_driver(spark, points, metric):
    rows = [(y, i, x[i].tolist(), 0.05 * (i + 1)) for y, x in points.items() for i in range(len(x))]
    df = spark.createDataFrame(rows, "layer long, expert int, v array<double>, p double")
    got = clustering.cluster_experts(df, "layer", "expert", "v", "p", 4, metric, isolated=[(0, 2), (2, 0), (2, 5)]).collect()
    for y, x in points.items():
        alone = [e for layer, e in [(0, 2), (2, 0), (2, 5)] if layer == y]
        rest = [i for i in range(len(x)) if i not in alone]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T if metric == "cosine" else np.linalg.norm(x[:, None] - x, axis=2)
        p = 0.05 * (np.arange(len(x)) + 1)
        d = (d * (1 + p[:, None] + p))[np.ix_(rest, rest)]
        np.fill_diagonal(d, 0)
        want = {frozenset(rest[i] for i in g) for g in plain_average_linkage(d, 4 - len(alone))[0]} | {frozenset([e]) for e in alone}
        assert as_sets(got, y, list(range(len(x)))) == want


def test_merges_need_no_window_over_elements(spark):
    e = spark.createDataFrame(pd.DataFrame({"k": [0, 0, 0, 0], "m": [1, 2, 1, 2], "p": [0, 0, 1, 1], "x": [1.0, -3.0, 2.0, 1.0]}))
    signs = {r.p: r.sign for r in experts.agreed_signs(e, ["k", "p"], "x").collect()}
    assert signs == {0: -1.0, 1: 1.0} and {r.p: r.sign for r in experts.agreed_signs(e, ["k", "p"], "x", "count").collect()} == {0: 0.0, 1: 1.0}
    assert {r.p: r.merged for r in experts.ties_merge(e, ["k"], "m", "p", "x", 1.0).collect()} == {0: -3.0, 1: 1.5}


def test_lanes_leave_in_the_order_of_a_plain_buffer(spark):
    import hashlib

    rows = catalogue.queries()["str04_buffer_shuffle"](spark, DATA).collect()
    ids = sorted(r.event_id for r in spark.read.parquet(DATA + "/events.parquet").select("event_id").collect())
    assert sorted(r.event_id for r in rows) == ids
    for lane in range(4):
        held, out = [], []
        for n, k in enumerate(i for i in ids if i % 4 == lane):
            if len(held) < 64:
                held.append(k)
            else:
                slot = int(hashlib.md5(f"42|{lane}|{n}".encode()).hexdigest()[:8], 16) % 64
                out.append(held[slot])
                held[slot] = k
        out += [k for _, k in sorted((hashlib.md5(f"42|{lane}|slot|{i}".encode()).hexdigest(), k) for i, k in enumerate(held))]
        assert [r.event_id for r in sorted((r for r in rows if r.lane == lane), key=lambda r: r.place)] == out
