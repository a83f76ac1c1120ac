"""Collocations, repeated byte strings and resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, decontam, induced, line_dedup, ngram_jaccard, quality, repeats, resampling, secrets, stages

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of to and red blue green house tree river stone cloud light dark small large walk run sing song".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 30 + 9 * i), "en" if i % 3 else "de", f"s{i % 3}", 1) for i in range(24)]
    rows += [(30, rows[4][1], "en", None, 1), (31, None, None, "s2", None), (32, "", "en", "s1", 0), (33, " \n\t.,", None, None, 1), (34, "word", "fr", "s1", 4)]
    rows += [(35, "x y " * 30_000, "fr", "s2", 1), (36, "y" * 300_000, "fr", "s0", 1), (30, rows[4][1], "en", None, 1), (None, rows[4][1], None, "s0", 1), (3, prose(77, 50), "en", "s0", 1)]
    rows += [(37, "Größe ÉTÉ größe " * 40 + rows[7][1][:150], "de", "s0", 1), (38, "123 the_the " * 60, "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOC)
    for c in ("score", "weight", "rank", "key", "digest", "doc", "start", "spans", "body", "n", "word", "w1", "dealt", "counts", "order", "place"):
        df = df.withColumn(c, F.lit(c))
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_collocations(rows, max_n, least, top, covered):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in found.items():
        if any(la == lang and len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for (la, q), b in found.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


@pytest.mark.parametrize(("max_n", "least", "top"), [(3, 3, 2000), (3, 10, 5), (4, 4, 40), (2, 2, 30)])
def test_collocations(docs, max_n, least, top):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, max_n, least, top).collect()}
    assert got == brute_collocations(rows, max_n, least, top, 50)


def test_collocations_in_small_parts(docs, monkeypatch):
    """Hot prefixes split, chunks and batches of a few rows: the same counts."""
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").where("length(text) < 5000").collect()]
    want = brute_collocations(rows, 3, 3, 2000, 50)
    conf, kept = docs.sparkSession.conf, docs.where("length(text) < 5000 OR text IS NULL")
    before = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (np.ones((2, collocations.BUCKETS), bool), np.zeros((2, collocations.BUCKETS), bool), np.arange(2 * collocations.BUCKETS).reshape(2, -1) % 3 == 0):
            monkeypatch.setattr(collocations, "hot_buckets", lambda *_, hot=hot: hot)
            got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(kept, 3, 3).collect()}
            assert got == want
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_collocations_of_nothing(docs, empty):
    assert collocations.collocations(empty).count() == 0 and collocations.collocations(docs.where("doc_id IN (31, 32, 33)")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**12, 10**12), (7 * 10**11, 10**12, 10**12 + 1)], "a long, l long, r long")
    expr = f"(cast({collocations.SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    assert [r.s for r in rows.select(F.expr(expr).alias("s")).collect()] == [10**6, 10**6 * 49 * 10**22 // (10**12 * (10**12 + 1))]


def naive_suffixes(strings):
    text = [0]
    for s in strings:
        text += [*s, 0]
    end = lambda i: next(j for j in range(i, len(text)) if not text[j])
    order = sorted((i for i, x in enumerate(text) if x), key=lambda i: (text[i : end(i)] + [0], end(i)))
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while text[a + k] == text[b + k] != 0:
            k += 1
        common.append(k)
    return text, order, common


@pytest.mark.parametrize("seed", range(6))
def test_induced_order(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(induced, "IN_MEMORY", r.choice([0, 64, 1 << 23]))  # files for nearly everything, or for nothing
    monkeypatch.setattr(induced, "BATCH", r.choice([3, 16, 1 << 17]))
    for _ in range(25):
        k = r.choice([1, 2, 3, 30])
        strings = [[r.randint(1, k) for _ in range(r.choice([0, 1, 3, 10, 40]))] for _ in range(r.randint(1, 6))]
        strings += [strings[0], strings[-1][1:] + strings[0]] if r.random() < 0.5 else []
        strings = [s * 3 for s in strings] if r.random() < 0.3 else strings
        text, order, common = naive_suffixes(strings)
        places, shared = [], []
        induced.suffix_order(np.array(text), k, lambda p, a: (places.extend(p.tolist()), shared.extend(a.tolist())), r.choice([None, 5, 17]), r.choice([0, 0, 30, 10**6]))  # noqa: B023
        assert places[::-1] == order and (not order or [0, *shared[:0:-1]] == common)


def test_queue_keeps_order():
    r, q, want = random.Random(2), induced.Queue(10, held=7), []
    for k in range(40):
        symbols = sorted(r.randint(5, 9) for _ in range(r.randint(0, 6)))
        q.push(np.array(symbols, np.int64), np.full(len(symbols), k), np.arange(len(symbols)))
        want += [(s, k, i) for i, s in enumerate(symbols)]
    first = q.pop(6, 9)
    fives = [x for x in want if x[0] == 5]
    assert [tuple(x) for x in first.T.tolist()] == fives[:9] and [tuple(x) for x in q.pop(6, 10**6).T.tolist()] == fives[9:]
    assert [tuple(x) for x in q.pop(10).T.tolist()] == sorted((x for x in want if x[0] > 5), key=lambda x: x[0]) and not q.pop(99).shape[1]


def brute_repeats(rows, length):
    """Rows (doc_id, hash order, text) in order; equal rows are one document."""
    seen, out = {}, {}
    for row in rows:
        data = row[2].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if seen.setdefault(w, (row, s)) != (row, s):
                gone[s : s + length] = b"\1" * length
        out[row] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def _removed(out):
    return out.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (t, s) -> t + s.end - s.start)").alias("n"), F.size("spans").alias("m"), F.sha2("kept", 256).alias("h"))


def ordered_rows(df):
    named = df.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).collect()
    return sorted({(r.doc_id, r.h, r.text) for r in named}, key=lambda r: (r[0] is None, r[0] or 0, r[1])), named


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 32, 10_000), (20, 8, 10_000), (20, 8, 1), (12, 12, 10_000)])
def test_repeats(docs, length, gram, hot):
    df = docs.where("doc_id IS NULL OR doc_id <> 36") if length < 100 else docs
    rows, named = ordered_rows(df)
    want = brute_repeats(rows, length)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n, r.m, r.h) for r in _removed(repeats.without_repeats(df, length, gram, hot)).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *want[r.doc_id, r.h, r.text]) for r in named)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_spliced_texts(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 64)  # long texts come in overlapping blocks (in this process only)
    parts = ["".join(r.choice("abc é") for _ in range(r.randint(10, 90))) for _ in range(12)]
    rows = [(k, "".join(r.choice(parts) if r.random() < 0.8 else r.choice("abcz") * r.randint(1, 40) for _ in range(r.randint(0, 8)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ordered, named = ordered_rows(df)
    want = brute_repeats(ordered, 24)
    got = {x.doc_id: (x.n_bytes, x.n, x.m, x.h) for x in _removed(repeats.without_repeats(df, 24, r.choice([4, 9, 24]))).collect()}
    assert got == {x.doc_id: want[x.doc_id, x.h, x.text] for x in named}


def test_bodies_in_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "PIECE_BYTES", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (0, 5, 30, 700, 30, 29, 1234)]
    seen = Counter()
    for first, offset, data, at in repeats.blocks(pa.array(texts), 30):
        text, _, _, start, windows, lead = repeats.bodies_of(data, at, 30, 10)
        for t, s, w, a in zip(text, start, windows, lead, strict=True):
            assert 0 <= a <= 20
            for k in range(w):
                seen[int(first + t), int(s - at[t] + offset + k)] += 1
    assert seen == Counter((i, s) for i, t in enumerate(texts) for s in range(len(t) - 29))


def test_repeats_of_nothing(empty):
    assert repeats.without_repeats(empty).count() == 0


def brute_resample(rows, target, percent, min_words, max_n, buckets, seed):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(g for _, x in rows for g in grams(words(x))), Counter(g for x in target for g in grams(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w = words(x)
        g = grams(w)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words))
    may = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    drawn = may[: len(may) * percent // 100]
    rest = list(out)
    for x in drawn:
        rest.remove(x)
    return sorted([(*x[:4], k + 1) for k, x in enumerate(drawn)] + [(*x[:4], None) for x in rest], key=repr)


@pytest.mark.parametrize(("percent", "least", "max_n", "buckets"), [(10, 20, 1, 10_000), (50, 5, 1, 50), (100, 0, 2, 997), (40, 20, 3, 64)])
def test_resampling(spark, docs, percent, least, max_n, buckets):
    target = spark.createDataFrame([("Red house, blue river the_the",), (None,), ("",), ("größe 123",)], "text string")
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, target, percent, least, max_n, buckets).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == brute_resample(rows, [r.text for r in target.collect()], percent, least, max_n, buckets, 2024)


def test_resampling_of_nothing(docs, empty):
    assert resampling.resample(empty, docs).count() == 0
    got = resampling.resample(docs.where("doc_id < 10"), empty).collect()
    assert len(got) == 11 and all(r.n_features >= 0 for r in got)


def test_crc_of_slices():
    r = random.Random(9)
    data = bytes(r.randrange(256) for _ in range(5000))
    starts = np.array([r.randint(0, 4000) for _ in range(300)])
    sizes = np.array([r.choice([0, 1, 2, 5, 63, 64, 65, 300]) for _ in range(300)])
    got = resampling.crc32(np.frombuffer(data, np.uint8), starts, sizes)
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
    assert resampling.crc32(np.frombuffer(data, np.uint8), starts, sizes, got).tolist() == [zlib.crc32(data[a : a + n] * 2) for a, n in zip(starts, sizes, strict=True)]


def test_tasks_of_few_very_long_sets(spark, monkeypatch):
    """Blocks cut by bytes: the same components as all pairs."""
    monkeypatch.setattr(ngram_jaccard, "CHUNK_BYTES", 1 << 14)
    monkeypatch.setattr(ngram_jaccard, "UNIT_BYTES", 1 << 12)
    r, rows = random.Random(21), []
    for g in range(4):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([60, 4000]))]
        for k in range(9):
            words = list(base)
            for at in r.sample(range(len(words)), len(words) // 150 * (k % 4)):
                words[at] = f"x{r.randint(0, 10**6)}"
            rows.append((100 * g + k, " ".join(words)))
    rows += [(900 + k, prose(k + 500, 30)) for k in range(6)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.lower().split()]}
    label = {i: i for i in sets}
    for _ in range(len(rows)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_null_item_ids(spark):
    item = " ".join(f"word{k}" for k in range(30))
    bench = spark.createDataFrame([(None, item), (3, item), (None, "other words entirely here now"), (2, None)], "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame([(1, f"so {item} it is")], "doc_id long, text string"), bench, block_tokens=1_000_000).collect()
    assert sorted(((r.item_id, r.n_matched) for r in got), key=repr) == [(3, 30), (None, 30)]
    assert stages.decontamination.__doc__


def test_blocks_count_words_of_any_script(spark):
    bench = spark.createDataFrame([(k, "слово дело место время рука глаз день " * 4) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "слово дело место время рука глаз день " * 4), (2, "нет")], "doc_id long, text string")
    many = decontam.contamination(docs, bench, block_tokens=30)
    assert {(r.doc_id, r.item_id) for r in many.collect()} == {(1, k) for k in range(6)}


def test_hosts_of_many_labels():
    host = "a.b.c.d.e.f.g-h.example.com:5432"
    text = f"user = someone\npassword = hunter22x\nhost {host}\n"
    spans = secrets.linked_spans(text, secrets.base_spans(text), None)
    assert ("endpoint", text.index(host), text.index(host) + len(host)) in spans
    for bad in ("a..b:80", "-a.b:80", "ab:8080", "a.-b:80", "x" * 64 + ".com:443"):
        odd = f"user = someone\npassword = hunter22x\nhost {bad}\n"
        assert not any(k == "endpoint" for k, *_ in secrets.linked_spans(odd, secrets.base_spans(odd), None)), bad


def test_line_dedup_of_an_id_with_several_texts(spark):
    rows = [(7, f"boiler line\nown {k}", f"s{k}") for k in range(12)] + [(8, "boiler line\nown 1", "s1")]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r.n_removed for r in out) == 12 and sum("boiler" in r.text for r in out) == 1
    assert next(r.n_removed for r in out if r.doc_id == 8) == 1


def test_near_duplicates_of_an_id_with_several_texts(spark):
    a, b, c = prose(901, 80), prose(902, 80), prose(903, 80)
    rows = [(1, a), (2, a), (2, b), (3, c), (4, b), (None, c), (5, ""), (6, None), (6, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    kept = sorted(((r.doc_id, r.text) for r in stages.near_duplicates(spark, df, "").collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, c), (5, ""), (6, None)], key=repr)


def test_score_takes_a_free_name(docs):
    """A column that is called as the score stays what it is."""
    assert "score" in docs.columns and quality.free_name(docs, "score") != "score" and quality.free_name(docs.drop("score"), "score") == "score"


def test_second_run_encodes_only_misses(docs, tmp_path):
    from corpusloom.llm import token_counts as tc

    cache, version = str(tmp_path / "cache"), tc.tokenizer_digest(tc.tokenizer_path(tc.PIECES))
    tc.append_misses(tc.named_texts(docs).where(F.hex("digest") < "8"), tc.PIECES, version, cache)
    first = {bytes(r.digest) for r in tc.stored_counts(docs.sparkSession, cache, version).collect()}
    got = tc.token_counts(docs, cache=cache).collect()
    after = [bytes(r.digest) for r in tc.stored_counts(docs.sparkSession, cache, version).collect()]
    assert len(after) == len(set(after)) == len({bytes(r.digest) for r in got}) and first and first < set(after) and all(x[0] < 128 for x in first)
    counter = tc.counter(tc.tokenizer_path(tc.PIECES))
    texts = {hashlib.sha256((r.text or "").encode()).digest(): r.text or "" for r in docs.select("text").collect()}
    assert all(r.n_tokens == counter.count(texts[bytes(r.digest)]) for r in got)
