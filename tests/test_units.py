"""Operators on small values: gold matrices, parsers, packing, splits."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import rewards
from corpusloom.functions import rewards as R
from corpusloom.functions import text as T
from corpusloom.operators import advantage, aggregates, clustering, experts, filters, joins, normalise, packing, sampling
from corpusloom.sources import files, refs
from corpusloom.sources.refs import DatasetMeta, DatasetRef, Registry, Subset, select_subsets

NO_FILE = lambda p: False


def test_reference_parts():
    r = DatasetRef.parse("HF::org/name:a / b#500", exists=NO_FILE)
    assert r == DatasetRef("org/name", ("a", "b"), 500, "hf")
    assert DatasetRef.parse("x#y:z#3", exists=lambda p: p == "x#y:z").sample == 3
    assert DatasetRef.parse("plain", exists=NO_FILE) == DatasetRef("plain")


_word = st.text("abcXYZ019_-./", min_size=1, max_size=8)


@given(_word, st.lists(st.text("abc019", min_size=1, max_size=5), max_size=3), st.none() | st.integers(1, 10**6), st.sampled_from([None, "hf", "ms"]))
@settings(max_examples=200, deadline=None)
def test_reference_round_trip(name, subsets, n, hub):
    ref = DatasetRef(name, tuple(subsets), n, hub)
    assert DatasetRef.parse(ref.format(), exists=NO_FILE) == ref


def test_registry_and_subsets(tmp_path):
    reg = Registry()
    meta = reg.register(DatasetMeta(hf_id="org/data", subsets=(Subset("a"), Subset("b", weak=True))))
    with pytest.raises(ValueError):
        reg.register(meta)
    assert reg.lookup(DatasetRef("org/data", hub="hf")) is meta
    assert reg.lookup(DatasetRef("/x/datasets--org--data/snapshots/1")) is meta
    assert [s.name for s in select_subsets(("all",), meta)] == ["a"]
    assert [s.subset for s in select_subsets(("other",), meta)] == ["other"]
    with pytest.raises(ValueError):
        select_subsets((), meta)
    (tmp_path / "d.json").write_text('[{"dataset_path": "rows.jsonl", "columns": {"q": "query"}, "subsets": ["default", {"name": "w", "is_weak_subset": true}]}]')
    entry = reg.register_json(str(tmp_path / "d.json"))[0]
    assert entry.path == str(tmp_path / "rows.jsonl") and entry.subsets[1].weak


def test_rename_collisions():
    assert normalise.rename_plan(["Query", "prompt", "answer"], {"query": "query", "prompt": "query", "answer": "response"}) == {"answer": "response"}
    assert normalise.rename_plan(["Prompt"], {"prompt": "query"}) == {"Prompt": "query"}


@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 50)), unique_by=lambda x: x[0], max_size=60), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_packing_invariants(items, volume):
    bins = packing.best_fit(items, volume)
    assert sorted(x for b in bins for x in b) == sorted(items)
    assert all(sum(n for _, n in b) <= volume or sum(n > 0 for _, n in b) == 1 for b in bins)


@given(st.integers(1, 500), st.floats(0.01, 0.99))
@settings(max_examples=100, deadline=None)
def test_split_sizes(n, ratio):
    if n == 1:
        with pytest.raises(ValueError):
            sampling.split_sizes(n, ratio)
        return
    train, val = sampling.split_sizes(n, ratio)
    assert train + val == n and val >= 1


def test_sampling_over_and_split(spark):
    df = spark.range(10)
    drawn = [r.id for r in sampling.sample(df, 25, "id").collect()]
    assert len(drawn) == 25 and min(drawn.count(i) for i in range(10)) == 2
    train, val = sampling.train_val_split(df, 0.3, "id")
    assert train.count() == 7 and val.count() == 3 and train.intersect(val).count() == 0
    both = sampling.interleave([spark.range(4), spark.range(100, 108)], [0.5, 0.5], "id", stop="all_exhausted")
    assert both.count() == 16


def test_ranks_follow_any_order(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 37, F.lit(11)))
    got = sorted(sampling.with_rank(df, [F.col("x"), F.col("id")]).select("rank", "x", "id").collect())
    assert [(r.x, r.id) for r in got] == sorted((i * 37 % 11, i) for i in range(1000))
    assert [r.rank for r in got] == list(range(1000))


def test_pairwise_frequency_gold(spark):
    for picks, gold in (([0, 1, 0], [[4, 3], [3, 2]]), ([1, 0, 1], [[2, 3], [3, 4]])):
        rows = spark.createDataFrame([(0, e) for e in picks], "layer int, expert int")
        got = experts.pairwise_frequency(experts.frequencies(rows, "layer", "expert"), "layer", "expert").collect()
        assert {(r.i, r.j): r.pair_frequency for r in got} == {(i, j): gold[i][j] for i in range(2) for j in range(2)}


def test_token_matrix_gold(spark):
    vec = {0: [1.0, 0.0], 1: [0.0, 1.0], 2: [-1.0, 0.0], 3: [0.0, -1.0]}
    outputs = spark.createDataFrame([(0, t, e, v) for t in range(4) for e, v in vec.items()], "layer int, token int, expert int, vec array<double>")
    routed = spark.createDataFrame([(0, t, t) for t in range(4)], "layer int, token int, expert int")
    got = {(r.i, r.j): r.distance for r in experts.token_matrix(routed, outputs, "layer", "token").collect()}
    gold = [[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]]
    assert all(abs(got[i, j] - gold[i][j] / 2) < 1e-6 for i in range(4) for j in range(4))
    few = experts.token_matrix(routed.where("expert < 2"), outputs, "layer", "token").where("i = 2 AND j = 3").first()
    assert few.distance == 0


def test_importance_weights_gold(spark):
    rows = spark.createDataFrame([(0, float(np.log(x))) for x in (0.5, 1.5, 3.0)], "seq int, lr double")
    for mode, gold in (("token_truncate", [0.5, 1.5, 2.0]), ("token_mask", [0.0, 0.5, 1.5])):
        got = sorted(r.weight for r in advantage.importance_weights(rows, "seq", "lr", mode, 2.0).collect())
        assert np.allclose(got, gold)
    same = advantage.importance_weights(spark.createDataFrame([(0, 0.0)] * 4, "seq int, lr double"), "seq", "lr", "token_truncate")
    m = advantage.weight_metrics(same).first()
    assert abs(m.ess - 1) < 1e-6 and m.is_weight_mean == 1 and m.clipped_frac == 0


def test_request_rewards_must_agree(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0), (1, 0, 2.0, 1)], "request int, grp int, reward double, o int")
    with pytest.raises(Exception, match="differ"):
        advantage.request_advantage(rows, "request", "grp", "reward", "o").collect()


def test_math_rewards():
    assert R.math_accuracy("so \\boxed{42}", "\\boxed{42}") == 1.0
    assert R.math_accuracy("so \\boxed{41}", "\\boxed{42}") == 0.0
    assert R.math_accuracy("\\boxed{\\frac{1}{2}}", "0.5") == 1.0
    assert R.math_accuracy("<answer>1,000</answer>", "1000") == 1.0
    assert R.math_accuracy(None, "") == 0.0
    assert R.countdown("<answer>(1 + 2) * 4 = 12</answer>", '{"target": 12, "nums": [1, 2, 4]}') == 1.0
    assert R.countdown("<answer>__import__('os')</answer>", '{"target": 1, "nums": []}') == 0.0
    with pytest.raises(ValueError):
        R.arithmetic("2 ** 8")


@given(st.text("ab:XY\n", max_size=30))
@settings(max_examples=12, deadline=None)
def test_split_parts_lossless(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(T.split_parts(F.col("t"), ["XY:", "X"]).alias("p")).first().p
    assert "".join(r.key + r.content for r in rows) == text
    assert all(r.key in ("XY:", "X") for r in rows[1:])


def test_quarantine_and_strict(spark):
    df = spark.range(4)
    good, bad = filters.quarantine(df, F.when(F.col("id") == 2, F.lit("two")))
    assert good.count() == 3 and bad.first()._error == "two"
    with pytest.raises(Exception, match="two"):
        filters.quarantine(df, F.when(F.col("id") == 2, F.lit("two")), strict=True)[0].collect()


def test_request_join_miss_raises(spark):
    inputs = spark.createDataFrame([(1, 5), (1, 4)], "k int, v int")
    assert joins.request_join(spark.createDataFrame([(1,)], "k int"), inputs, "k", "v").first().v == 4
    with pytest.raises(Exception, match="no input"):
        joins.request_join(spark.createDataFrame([(2,)], "k int"), inputs, "k", "v").collect()


def test_literal_history_and_bad_literals(spark):
    rows = spark.createDataFrame([("q", "r", "[['a', 'b']]"), ("q", "r", "not a list")], "query string, response string, history string")
    got = [len(r.messages) for r in normalise.responses(rows).collect()]
    assert got == [4, 2]


def test_linkage_sizes():
    d = np.abs(np.subtract.outer(np.array([0.0, 1, 2, 10, 11]), np.array([0.0, 1, 2, 10, 11])))
    assert clustering.linkage_labels(d, 2).tolist() == [0, 0, 0, 1, 1]
    assert max(np.bincount(clustering.linkage_labels(d, 2, "two-row mean", max_size=2))) <= 2
    assert clustering.hull_area(np.array([[0, 0], [0, 2], [2, 0], [2, 2], [1, 1]])) == 4


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ü", 1, ""), ("b", None, "x")], "a string, n int, c string")
    files.write_jsonl(df, str(tmp_path / "x.jsonl"))
    assert sorted(map(str, files.read_file(spark, str(tmp_path / "x.jsonl"), df.schema).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "t.csv").write_text("system,instruction,output\n,do,3.3\n")
    row = files.read_file(spark, str(tmp_path / "t.csv")).first()
    assert row.system == "" and row.output == "3.3"


def test_fixture_layouts(spark, tmp_path):
    """The shapes of the reference inputs, through load_dataset."""
    from corpusloom.plans.loader import load_dataset

    cases = {
        "alpaca.csv": ("system,instruction,input,output\n,i,x,3.3\n", [("user", "i\nx"), ("assistant", "3.3")]),
        "alpaca2.csv": ("instruction,output\ni,o\n", [("user", "i"), ("assistant", "o")]),
        "chatml.jsonl": ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}\n', [("user", "a"), ("assistant", "b")]),
        "conversations.jsonl": ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}\n', [("user", "a"), ("assistant", "b")]),
        "sharegpt.jsonl": ('{"system": "s", "conversation": [{"human": "a", "assistant": "b"}]}\n', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        "multi.json": ('[{"query": "q", "response": "r", "history": [["a", "b"]]}]', [("user", "a"), ("assistant", "b"), ("user", "q"), ("assistant", "r")]),
        "pre.jsonl": ('{"response": "r"}\n', [("assistant", "r")]),
    }
    for name, (text, gold) in cases.items():
        (tmp_path / name).write_text(text)
        train, val = load_dataset(spark, str(tmp_path / name))
        got = [(m.role, m.content) for m in train.first().messages if m.content != ""]
        assert val is None and got == gold, name


def test_eval_crawl(spark, tmp_path):
    for k, text in (("m1", '{"acc": 0.5}'), ("m2", "broken")):
        os.makedirs(tmp_path / k / "eval")
        (tmp_path / k / "eval" / "a.json").write_text(text)
    got = files.eval_artifacts(spark, str(tmp_path), {"a": "a.json"}, {"a": {"acc": "$.acc"}}).collect()
    assert sorted(str(r.acc) for r in got) == ["0.5", "None"]


def test_entropy_of_uniform(spark):
    row = spark.range(1).select(aggregates.entropy(aggregates.softmax(F.array(*[F.lit(0.0)] * 4))).alias("h")).first()
    assert abs(row.h - np.log(4)) < 1e-9


def test_lcs_by_brute_force():
    import random

    from corpusloom.functions import overlap

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 40))] for _ in range(2))
        assert {overlap.lcs(a, b, width) for width in (1, 3, 8, 4096)} == {plain(a, b)}


def test_rouge_l_and_bleu_read_whole_texts(spark, tmp_path):
    from corpusloom.functions import overlap
    from corpusloom.plans import catalogue

    texts = [" ".join(f"w{k * k % 97}" for k in range(n)) for n in (3, 5, 30, 200)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["agg08_rouge_l_bleu_4"](spark, str(tmp_path)).first()
    pairs = [(w, w[4:]) for w in ((x or "").split() for x in texts) if len(w) > 4]
    assert got.rouge_l == pytest.approx(100 * sum(overlap.rouge_l_score(a, b) for a, b in pairs) / len(pairs), abs=1e-5)
    assert got.bleu_4 == pytest.approx(100 * sum(overlap.bleu4_score(a, b) for a, b in pairs) / len(pairs), abs=1e-5)


def test_bleu_smoothing_gold():
    from corpusloom.functions import overlap

    got = overlap.bleu4_score("a b c d e".split(), "a b x d e".split())
    assert got == pytest.approx((4 / 5 * 2 / 4 * (1 / 2) / 3 * (1 / 4) / 2) ** 0.25)
    assert overlap.bleu4_score("a".split(), "b".split()) == 0 and overlap.bleu4_score([], ["b"]) == 0
    assert overlap.bleu4_score("a b c d".split(), "a b c d e".split()) == pytest.approx(math.exp(1 - 5 / 4))


def test_format_rewards_at_the_start(spark):
    c = ["<think>a</think>\nAction: x\nAction Input: {}", "preface\n<think>a</think>\nAction: x\nAction Input: {}"]
    got = spark.createDataFrame([(x,) for x in c], "c string").select(rewards.react_format(F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == [1.0, 0.0]
    assert rewards.countdown("<answer>1+2</answer>", None) == 0 and rewards.countdown("<answer>1+2</answer>", "[1]") == 0
    assert rewards.countdown("<answer>1+2</answer>", '{"nums": [2, 1], "target": 3}') == 1


def test_gram_hashes_count_as_strings(spark):
    texts = ["", "a", "a b", "a b a b a b", " ".join(f"w{k % 7}" for k in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for n in (1, 2, 3, 4):
        got = {r.k: (r.n, r.u) for r in df.withColumn("h", aggregates.hashed_words(F.filter(F.split("t", " "), lambda w: w != ""))).select("k", F.size(aggregates.gram_hashes(F.col("h"), n)).alias("n"), F.size(F.array_distinct(aggregates.gram_hashes(F.col("h"), n))).alias("u")).collect()}
        for k, t in enumerate(texts):
            grams = list(zip(*(t.split()[i:] for i in range(n)), strict=False))
            assert got[k] == (len(grams), len(set(grams)))


def test_exact_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g in range(3) for x in np.round(r.exponential(5, 4000 * g + 1), 1 + g)] + [(7, None), (0, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    for q in (0.0, 0.5, 0.8, 0.995, 1.0):
        got = {r.g: r.q for r in sampling.exact_quantile(df, "x", q, ["g"], "q").collect()}
        for g in range(3):
            assert got[g] == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], q), rel=1e-12)
        assert sampling.exact_quantile(df, "x", q, [], "q").first().q == pytest.approx(np.quantile([x for _, x in rows if x is not None], q), rel=1e-12)
    from corpusloom.operators.advantage import quantile_mask

    kept = quantile_mask(df, "x", 0.2, "g").where("keep").groupBy("g").count().collect()
    for k in kept:
        xs = np.array([x for g, x in rows if g == k.g and x is not None])
        assert k["count"] == (xs >= np.quantile(xs, 0.8)).sum()
    assert quantile_mask(df.limit(0), "x", 0.2).count() == 0 and quantile_mask(df, "x", 0.2).count() == len(rows)


def test_ranks_of_names_that_begin_alike(spark):
    names = [f"https://example.org/page-{k:05d}" for k in range(500)]
    got = sampling.with_rank(spark.createDataFrame([(x,) for x in reversed(names)], "u string"), [F.col("u")]).collect()
    assert {r.u: r["rank"] for r in got} == {x: i for i, x in enumerate(names)}


def test_packs_as_a_plain_search_makes_them(spark):
    r = np.random.default_rng(4)
    items = [(int(k), int(x)) for k, x in enumerate(r.integers(1, 70, 300))] + [(900, 120), (901, 0)]
    bins = []
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = [b for b in bins if sum(s for _, s in b) + size <= 64]
        best = min(fit, key=lambda b: (64 - sum(s for _, s in b), bins.index(b)), default=None)
        if best is None:
            bins.append([(key, size)])
        else:
            best.append((key, size))
    got = packing.pack(spark.createDataFrame(items, "k long, n long"), "k", F.col("n"), 64).collect()
    assert {(x.k, x.pack_id, x.pos) for x in got} == {(k, b, i) for b, rows in enumerate(bins) for i, (k, _) in enumerate(rows)}


def test_vector_statistics_against_numpy(spark):
    r = np.random.default_rng(6)
    x = {g: r.standard_normal((300, 6)) @ np.diag([3, 2, 1, 1, 0.5, 0.1]) + g for g in (0, 1)}
    df = spark.createDataFrame([(g, v.tolist()) for g, m in x.items() for v in m] + [(0, None)], "g long, v array<double>").repartition(5)
    ranks = {k.g: k.effective_rank for k in clustering.effective_rank(df, "g", "v").collect()}
    found = {k.g: k for k in clustering.collapse_metrics(df, "g", "v").collect()}
    for g, m in x.items():
        e = np.linalg.eigvalsh(np.cov(m.T, bias=True))
        p = e / e.sum()
        assert ranks[g] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
        c = m - m.mean(0)
        _, s, v = np.linalg.svd(c, full_matrices=False)
        y = c @ v[:2].T
        k = found[g]
        assert (k.pc1_share, k.pc2_share, k.spread) == pytest.approx((s[0] ** 2 / (s**2).sum(), s[1] ** 2 / (s**2).sum(), np.linalg.norm(c, axis=1).mean()))
        assert k.hull_area == pytest.approx(clustering.hull_area(y))
        h = np.histogram2d(y[:, 0], y[:, 1], 10)[0].ravel() / len(y)
        assert k.entropy == pytest.approx(-(h[h > 0] * np.log(h[h > 0])).sum(), abs=0.05)
    both = np.concatenate(list(x.values()))
    corr = np.corrcoef(both.T)
    assert clustering.mean_coupling(df, "v").first().coupling == pytest.approx(np.abs(corr[np.triu_indices(6, 1)]).mean())


def test_linkage_against_a_plain_search():
    """Merges by the definition: distances between groups from all pairs of their members."""
    r = np.random.default_rng(8)
    for _ in range(20):
        p = r.standard_normal((9, 3))
        d = np.linalg.norm(p[:, None] - p, axis=2)
        for kind, value in (("single", np.min), ("complete", np.max), ("average", np.mean)):
            groups = [[i] for i in range(9)]
            while len(groups) > 3:
                a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda q: value(d[np.ix_(groups[q[0]], groups[q[1]])]))
                groups[b] += groups.pop(a)
            label = clustering.linkage_labels(d, 3, kind)
            assert {tuple(np.flatnonzero(label == k)) for k in range(3)} == {tuple(sorted(g)) for g in groups}


def test_kmeans_finds_apart_groups_and_costs_fall():
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((8, 4)) * 0.1 + c for c in (0, 10, 20)])
    label, cost = clustering.lloyd(x, 3)
    assert [set(label[k : k + 8]) for k in (0, 8, 16)] == [{0}, {1}, {2}]
    assert cost == pytest.approx(sum(((g - g.mean(0)) ** 2).sum() for g in (x[:8], x[8:16], x[16:])))
    costs = [clustering.lloyd(x, k)[1] for k in (1, 3, 24)]
    assert costs[0] > costs[1] > costs[2] == pytest.approx(0, abs=1e-9)


def test_uri_references(spark, tmp_path):
    from corpusloom.plans.loader import REGISTRY, load_dataset

    ref = refs.DatasetRef.parse("hdfs://nn:8020/data/set:a/b#30")
    assert (ref.dataset, ref.subsets, ref.sample, ref.hub) == ("hdfs://nn:8020/data/set", ("a", "b"), 30, None) and refs.DatasetRef.parse(ref.format()) == ref
    assert refs.DatasetRef.parse("s3a://b/x.jsonl#5").is_file and refs.DatasetRef.parse("s3a://b/x").is_folder
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "train.jsonl").write_text('{"query": "q", "response": "r"}\n' * 4)
    for text in (f"file://{tmp_path}/d", f"file://{tmp_path}/d#2", f"file://{tmp_path}/d/train.jsonl"):
        train, _ = load_dataset(spark, text)
        assert train.count() == (2 if text.endswith("#2") else 4)
    assert REGISTRY.lookup(refs.DatasetRef.parse("hf::openai/gsm8k")).name == "gsm8k" and REGISTRY.lookup(refs.DatasetRef.parse("ms::other/gsm8k")).name == "gsm8k"


def test_plugins_load_and_register(spark, tmp_path):
    from corpusloom import plugins

    path = tmp_path / "mine.py"
    path.write_text("from corpusloom import plugins\nfrom pyspark.sql import functions as F\n"
                    "plugins.register(plugins.REWARDS, 'length', lambda c: F.length(c).cast('double'), exist_ok=True)\n"
                    "plugins.register(plugins.NORMALISERS, 'upper', lambda df: df.select(F.upper('q').alias('q')).where(\"q <> ''\"), exist_ok=True)\n"
                    "plugins.register(plugins.TEMPLATES, 'bars', lambda m: F.array_join(F.transform(m, lambda x: x['content']), '|'), exist_ok=True)\n"
                    "plugins.register(plugins.METRICS, 'most', lambda df, c: df.agg(F.max(c).alias('value')), exist_ok=True)\n"
                    "plugins.register(plugins.LOSS_SCALES, 'none', lambda m: F.transform(m, lambda x: F.lit(0.0)), exist_ok=True)\n")
    plugins.load_plugins(spark, str(path))
    df = spark.createDataFrame([("ab",), ("",)], "q string")
    assert [r.r for r in df.select(plugins.REWARDS["length"](F.col("q")).alias("r")).collect()] == [2.0, 0.0]
    assert [r.q for r in plugins.NORMALISERS["upper"](df).collect()] == ["AB"] and plugins.METRICS["most"](df, "q").first().value == "ab"
    m = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], "m array<struct<role string, content string>>")
    assert m.select(plugins.TEMPLATES["bars"](F.col("m")).alias("t"), plugins.LOSS_SCALES["none"](F.col("m")).alias("s"), plugins.LOSS_SCALES["default"](F.col("m")).alias("d")).first() == ("a|b", [0.0, 0.0], [0.0, 1.0])
    with pytest.raises(ValueError):
        plugins.register(plugins.REWARDS, "format", len)


def test_off_policy_means_next_to_a_tie_are_those_of_the_sql(spark, tmp_path):
    import random

    import duckdb

    from corpusloom.plans import catalogue

    r = random.Random(4)
    rows = [(k, k % 40, round(r.expovariate(1 / 60), 2)) for k in range(40 * 64)]  # means of 64 terms end in 5 at the seventh place
    rows += [(k, 40 + k % 30, round(r.expovariate(1 / 60), 2)) for k in range(len(rows), len(rows) + 30 * 65)]  # and of 65 may be 0.01
    files = [spark.createDataFrame(rows[i::5], "event_id long, user_id long, value double").coalesce(1) for i in range(5)]
    for x in files:
        x.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(x) for x in catalogue.queries()["flt12_off_policy_mask"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    assert got == sorted(c.execute(catalogue.oracle_sql()["flt12_off_policy_mask"]).fetchall())


@pytest.mark.parametrize("out_rows", [100_000, 1000])
def test_shuffle_buffer_calls_the_state_by_slot_not_by_row(monkeypatch, out_rows):
    import hashlib
    from types import SimpleNamespace

    import pandas as pd

    from corpusloom.streaming import streams

    monkeypatch.setattr(streams, "OUT_ROWS", out_rows)

    class State(dict):
        """A map state, or a value state under None; counts its calls."""

        calls = 0

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

        def iterator(self):
            return iter(list(self.items()))

        def exists(self):
            return bool(self)

    slots, counts = State(), State()
    counts.get, counts.update = lambda: dict.get(counts, None), lambda v: counts.__setitem__(None, v)
    handle = SimpleNamespace(getMapState=lambda *_: slots, getValueState=lambda *_: counts, listTimers=lambda: [])
    lane = streams.ShuffleBuffer(8, 42, None)
    lane.init(handle)
    keys, held, want = [k * 7 % 30_011 for k in range(30_011)], [], []
    parts = (keys[:3], keys[3:9], keys[9:20_000], keys[20_000:])
    got = []
    for part in parts:
        pdf = pd.DataFrame({"lane": 1, "key": part, "row": [f"r{k}" for k in part]})
        for x in lane.handleInputRows((1,), iter([pdf[::2], pdf[1::2]]), None):
            got += x[["lane", "place", "key", "row"]].values.tolist()
        for k in sorted(part):
            if len(held) == 8:
                slot = int(hashlib.md5(f"42|1|{len(want) + 8}".encode()).hexdigest()[:8], 16) % 8
                want.append([1, len(want), held[slot], f"r{held[slot]}"])
                held[slot] = k
            else:
                held.append(k)
    assert got == want and [slots[i,] for i in range(8)] == [(k, f"r{k}") for k in held]
    assert slots.calls <= 8 * len(parts)


def test_overlap_of_long_texts_with_common_ends():
    import time

    from corpusloom.functions import overlap

    a = [f"w{k * k % 9973}" for k in range(400_000)]
    start = time.monotonic()
    assert overlap.lcs(a, a[4:]) == len(a) - 4 and overlap.lcs(["x", *a[1:200_000], "y", "z", *a[200_002:]], a) == len(a) - 3
    assert overlap.lcs(["a\0", "b"], ["a", "b"]) == 1 and overlap.lcs(["a"] * 3, ["a"] * 2) == 2 and overlap.lcs([], ["a"]) == 0
    assert time.monotonic() - start < 8


def test_overlap_scores_of_parts_are_those_of_rows(spark, monkeypatch):
    import random

    import pyarrow as pa

    from corpusloom.functions import overlap

    r = random.Random(6)
    text = lambda: [r.choice(["a", "b", "c", "d\0", "d", ""]) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 40]))]
    rows = [(text(), text()) for _ in range(300)]
    want = [(overlap.rouge_l_score(a, b), overlap.bleu4_score(a, b)) for a, b in rows]
    for words in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(overlap, "COUNT_WORDS", words)
        parts = list(overlap._numbered(pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])))
        assert [x for p in parts for x in zip(overlap._rouge_l_scores(*p), overlap._bleu4_scores(*p), strict=True)] == want
    df = spark.createDataFrame([*rows, (None, ["a"]), (["a"], None)], "a array<string>, b array<string>").repartition(1)
    got = df.select(overlap.scores(F.col("a"), F.col("b")).alias("x"), overlap.bleu4(F.col("a"), F.col("b")).alias("y")).collect()
    assert sorted((tuple(x.x) for x in got), key=str) == sorted([*want, (None, None), (None, None)], key=str) and all(x.y == x.x.bleu_4 for x in got)
