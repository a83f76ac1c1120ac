"""Phrase collocations by counting truncated suffixes (suffix-sigma), scored at their weakest cut.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and these at blanks into words; all counts
are per language. Every word begins a suffix of its piece, truncated to `max_n` words. Equal suffixes are added up in
the map task, in chunks, and shuffled by language and first word. Each task sorts its suffixes reverse-lexicographically,
so that all suffixes that begin with a phrase follow one another, and one stack of the open prefixes (one of each length)
counts all phrases in a single pass over the sorted stream. Parts of candidates are phrases that occur at least as often as the
candidate, so everything that a score needs is among the phrases kept; they are joined to the candidates afterwards.

Skew: a first pass counts suffixes by hash buckets of their prefixes (a vector of bounded size for each prefix length,
merged as a tree). Where a bucket holds more than 1 / HOT of all suffixes, they are shuffled by one word more; the
stacks then give partial counts of the shorter prefix, which are added up. So no word or word pair is one task's own.

Words travel as 64-bit hashes of language and word; each task sends a word's text beside its suffixes, and words
that share a hash raise an error (choose another seed) where the shuffle brings them together; two words share one at
odds of about 3e-6 for ten million words.

Cases: null and empty texts have no words; a null lang is `und`; repeated rows each count; phrases never span pieces or
texts; ties go by occurrences, then by the UTF-8 bytes of the phrase; empty tables give an empty result; other columns
are ignored. Long texts are worked on in parts cut between pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, materialise
from corpusloom.llm.textbytes import UPPER_TO_LOWER, pieces, runs
from corpusloom.session import table

MAX_N, MIN_COUNT, TOP, COVERED, SCALE = 3, 10, 2000, 50, 1_000_000
#: Suffixes that are added up at once in a map task, and rows sent at once; words whose texts a task remembers as sent.
CHUNK, SENT_AT_ONCE, SENT = 3 << 20, 1 << 16, 1 << 20
#: Buckets of prefixes, and the share (1 / HOT) of all suffixes from which a bucket is split.
BUCKETS, HOT = 1 << 16, 512
#: A language's candidates are first ranked in so many parts.
PARTS = 64
NONE = np.iinfo(np.int64).min
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_IN_WORD = ~_ENDS
_IN_WORD[[9, 32]] = False
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^k, base^-k) modulo 2^64 for k up to n."""
    size = max(1 << 19, 1 << n.bit_length())
    if size not in _powers:
        made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        if size > 1 << 19:
            return tuple(made)
        _powers[size] = tuple(made)
    return _powers[size]


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of slices of bytes, as differences of one running sum."""
    up, down = powers(len(data))
    codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) | np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[data] * up[: len(data)])])
    return mix((total[ends] - total[starts]) * down[starts])


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of UTF-8 bytes as an Arrow column."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    where = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[where]))


def lang_codes(langs: list[str], seed: int) -> np.ndarray:
    return np.array([zlib.crc32(x.encode(), seed) << 32 | zlib.crc32(x.encode()[::-1], seed + 1) for x in langs], np.uint64)


def suffixes(batch: pa.RecordBatch, max_n: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a batch (text, lang): hashes of the suffixes' words (max_n rows, NONE beyond a piece), the text of each, and where its first word stands."""
    coded = batch.column("lang").dictionary_encode()
    codes = lang_codes(coded.dictionary.to_pylist(), seed)[coded.indices.to_numpy()]
    for first, data, at in pieces(batch.column("text"), _ENDS):
        starts, ends = runs(_IN_WORD[data], at)
        if not len(starts):
            continue
        low = UPPER_TO_LOWER[data]
        text = np.searchsorted(at, starts, "right") - 1
        one = mix(slice_hashes(low, starts, ends, seed) + codes[first + text]).view(np.int64)
        one[one == NONE] = 1
        piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
        joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        words = np.full((max_n, len(one)), NONE, np.int64)
        words[0] = one
        for k in range(1, max_n):  # a suffix without a k-th word has no further one
            words[k, :-1] = np.where(joined, words[k - 1, 1:], NONE)
        yield words, first + text, starts, ends, low


def prefix_bucket(words: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the first n words."""
    h = np.zeros(words.shape[1], np.uint64)
    for k in range(n):
        h = mix(h + words[k].view(np.uint64) * np.uint64(_BASE))
    return (h >> np.uint64(48)).astype(np.int64)


def survey(docs: DataFrame, max_n: int, seed: int) -> DataFrame:
    """One row a batch and language with its words, and one a partition with the suffixes by prefix bucket (max_n - 1 vectors)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("vectors", pa.binary())])
        total = np.zeros((max_n - 1, BUCKETS), np.int64)
        for batch in batches:
            words_of = np.zeros(batch.num_rows, np.int64)
            for words, text, *_ in suffixes(batch, max_n, seed):
                words_of += np.bincount(text, minlength=batch.num_rows)
                for n in range(1, max_n):
                    total[n - 1] += np.bincount(prefix_bucket(words, n), minlength=BUCKETS)
            per = pa.table({"lang": batch.column("lang"), "n": words_of}).group_by("lang").aggregate([("n", "sum")])
            yield from pa.table({"lang": per["lang"], "n": per["n_sum"], "vectors": pa.nulls(per.num_rows, pa.binary())}, schema=kinds).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=kinds)

    return docs.mapInArrow(count, "lang string, n long, vectors binary")


def hot_buckets(surveyed: DataFrame, max_n: int) -> np.ndarray:
    """For each prefix length under max_n which buckets are split; the vectors are merged as a tree."""
    none = surveyed.sparkSession.sparkContext.parallelize([np.zeros((max_n - 1) * BUCKETS, np.int64)], 1)
    vectors = surveyed.where("vectors IS NOT NULL").select("vectors").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    total = vectors.union(none).treeReduce(np.add, depth=3).reshape(max_n - 1, BUCKETS)
    return total * HOT > total.sum(axis=1, keepdims=True)


def split_prefixes(words: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
    """For each prefix length under max_n: whether suffixes are dealt by one word more; only where shorter prefixes are split too."""
    found = [hot[n - 1][prefix_bucket(words, n)] for n in range(1, len(words))]
    return list(np.logical_and.accumulate(found)) if found else []


def shuffled_suffixes(docs: DataFrame, hot: np.ndarray, max_n: int, seed: int) -> DataFrame:
    """(dealt, w1.., n, lang, word): suffixes added up in chunks, and the texts of words (n = 0) that a task has not sent yet."""
    names = [f"w{k + 1}" for k in range(max_n)]
    kinds = pa.schema([("dealt", pa.int64()), *((x, pa.int64()) for x in names), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string())])

    def dealt(words: np.ndarray) -> np.ndarray:
        h = mix(words[0].view(np.uint64))
        for k, split in enumerate(split_prefixes(words, hot), 1):
            h = np.where(split, mix(h + words[k].view(np.uint64)), h)
        return h.view(np.int64)

    def add_up(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Equal suffixes as one row each, by their first words, so that the shuffle's blocks compress well."""
        words = np.concatenate(held, axis=1)
        held.clear()
        rest = np.zeros(words.shape[1], np.uint64)
        for row in words[1:]:
            rest = mix(rest + row.view(np.uint64) * np.uint64(_BASE))
        order = np.argsort((words[0].view(np.uint64) >> np.uint64(32) << np.uint64(32)) | rest >> np.uint64(32))
        del rest
        for k, row in enumerate(words):
            words[k] = row[order]
        new = np.ones(words.shape[1], bool)
        new[1:] = False
        for row in words:
            new[1:] |= row[1:] != row[:-1]
        begins = np.flatnonzero(new)
        n = np.diff(np.append(begins, words.shape[1]))
        for a in range(0, len(begins), SENT_AT_ONCE):
            part = words[:, begins[a : a + SENT_AT_ONCE]]
            blank = pa.nulls(part.shape[1], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(dealt(part)), *map(pa.array, part), pa.array(n[a : a + SENT_AT_ONCE]), blank, blank], schema=kinds)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(SENT, np.int64)
        held, count = [], 0
        for batch in batches:
            langs = batch.column("lang")
            for words, text, starts, ends, low in suffixes(batch, max_n, seed):
                new = np.flatnonzero(sent[words[0] & (SENT - 1)] != words[0])
                _, at = np.unique(words[0][new], return_index=True)
                new = new[at]
                sent[words[0][new] & (SENT - 1)] = words[0][new]
                alone = np.full((max_n, len(new)), NONE, np.int64)
                alone[0] = words[0][new]
                yield pa.RecordBatch.from_arrays([pa.array(dealt(alone)), *map(pa.array, alone), pa.array(np.zeros(len(new), np.int64)), langs.take(pa.array(text[new])), texts_of(low, starts[new], ends[new])], schema=kinds)
                held.append(words)
                count += words.shape[1]
                if count >= CHUNK:
                    yield from add_up(held)
                    count = 0
        if held:
            yield from add_up(held)

    return docs.mapInArrow(emit, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in kinds))


def count_prefixes(rows: DataFrame, hot: np.ndarray, max_n: int, min_count: int) -> DataFrame:
    """(size, w1.., n, lang, word) of all phrases in suffixes sorted in descending order: one stack of open prefixes.

    Phrases with less than min_count occurrences are left out, except those whose counts are partial."""
    names = [f"w{k + 1}" for k in range(max_n)]
    kinds = pa.schema([("size", pa.int32()), *((x, pa.int64()) for x in names), ("n", pa.int64()), ("lang", pa.string()), ("word", pa.string())])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full(max_n, NONE, np.int64)  # the open prefixes are those of this suffix
        open_counts, said = [0] * max_n, (None, None)

        def closed(size: int, words: np.ndarray, n: np.ndarray, lang: pa.Array | None = None, word: pa.Array | None = None) -> pa.RecordBatch:
            keep = words[size - 1] != NONE
            if size < max_n:
                keep &= (n >= min_count) | hot[size - 1][prefix_bucket(words, size)]
            else:
                keep &= n >= min_count
            keep = np.flatnonzero(keep)
            own = [words[k][keep] if k < size else np.full(len(keep), NONE, np.int64) for k in range(max_n)]
            blank = pa.nulls(len(keep), pa.string())
            picked = [blank if c is None else c.take(pa.array(keep)) for c in (lang, word)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), size, np.int32)), *map(pa.array, own), pa.array(n[keep]), *picked], schema=kinds)

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            words = np.stack([batch.column(x).to_numpy() for x in names])
            n = batch.column("n").to_numpy()
            whole = np.concatenate([top[:, None], words], axis=1)
            changed = np.zeros(m, bool)
            for size in range(1, max_n + 1):
                changed = changed | (whole[size - 1, 1:] != whole[size - 1, :-1])
                begins = np.flatnonzero(changed)
                at = np.concatenate([[0], begins]) if not len(begins) or begins[0] else begins
                sums = np.add.reduceat(n, at)
                # What is open goes on in the first group, or closes before it.
                first = np.array([open_counts[size - 1]]) if changed[0] else np.zeros(0, np.int64)
                if not changed[0]:
                    sums[0] += open_counts[size - 1]
                groups = np.concatenate([first, sums]).astype(np.int64)
                keys = np.concatenate([whole[:, :1], words[:, at]], axis=1) if changed[0] else words[:, at]
                open_counts[size - 1] = int(groups[-1])
                if size == 1:
                    # The texts of a first word come at the end of its suffixes.
                    where = np.flatnonzero(batch.column("word").is_valid().to_numpy(zero_copy_only=False))
                    group = (np.searchsorted(at, where, "right") - 1 + len(first)).astype(np.int64)
                    langs, texts = [None] * len(groups), [None] * len(groups)
                    langs[0], texts[0] = said
                    for g, la, te in zip(group.tolist(), batch.column("lang").take(pa.array(where)).to_pylist(), batch.column("word").take(pa.array(where)).to_pylist(), strict=True):
                        if texts[g] is not None and (texts[g], langs[g]) != (te, la):
                            raise ValueError(f"{texts[g]!r} and {te!r} share a hash: choose another seed")
                        langs[g], texts[g] = la, te
                    said = (langs[-1], texts[-1])
                    yield closed(size, keys[:, :-1], groups[:-1], pa.array(langs[:-1], pa.string()), pa.array(texts[:-1], pa.string()))
                else:
                    yield closed(size, keys[:, :-1], groups[:-1])
            top = words[:, -1].copy()
        for size in range(1, max_n + 1):
            parts = [pa.array([x], pa.string()) for x in said] if size == 1 else [None, None]
            yield closed(size, top[:, None], np.array([open_counts[size - 1]], np.int64), *parts)

    return rows.select(*names, "n", "lang", "word").mapInArrow(stack, ", ".join(f"{f.name} {dict(size='int', lang='string', word='string').get(f.name, 'long')}" for f in kinds))


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(phrases: key (hashes of the words), n, lang, word (of single words); totals: lang, n) of rows (text, lang)."""
    names = [f"w{k + 1}" for k in range(max_n)]
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    surveyed = materialise(survey(docs, max_n, seed), "survey")
    hot = hot_buckets(surveyed, max_n)
    rows = shuffled_suffixes(docs, hot, max_n, seed).repartition("dealt").sortWithinPartitions(*[F.col(x).desc() for x in names])
    counted = count_prefixes(rows, hot, max_n, min_count).groupBy("size", *names).agg(F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("word").alias("word"))
    key = F.slice(F.array(*names), F.lit(1), F.col("size")).alias("key")
    phrases = materialise(counted.where(F.col("n") >= min_count).select("size", key, "n", "lang", "word"), "phrases")
    totals = surveyed.where("n > 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return phrases, totals


def whole(x: str, digits: int) -> Column:
    return F.col(x).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut) of each language's best phrases of 2 to max_n words."""
    phrases, totals = phrase_counts(docs, max_n, min_count, seed)
    candidates = phrases.where("size > 1").select("size", "key", F.col("n").alias("a"))
    # Longer candidates hold a phrase inside any if one that is longer by a word does, since that occurs at least as often.
    inner = F.explode(F.array(F.expr("slice(key, 1, size - 1)"), F.expr("slice(key, 2, size - 1)"))).alias("key")
    longer = candidates.where("size > 2").select(inner, "a").groupBy("key").agg(F.max("a").alias("most"))
    left = candidates.join(longer, "key", "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True))).select("size", "key", "a")
    left = materialise(left, "candidates")
    cuts = left.select("size", "key", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"))
    cuts = cuts.select("key", "a", "cut", F.expr("slice(key, 1, cut)").alias("before"), F.expr("slice(key, cut + 1, size - cut)").alias("after"))
    cuts = cuts.join(phrases.select(F.col("key").alias("before"), F.col("n").alias("l")), "before").join(phrases.select(F.col("key").alias("after"), F.col("n").alias("r")), "after")
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("key").agg(F.min("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    words = phrases.where("size = 1").select(F.col("key")[0].alias("w"), "lang", "word")
    spelt = left.select("key", F.posexplode("key").alias("at", "w")).join(words, "w").groupBy("key").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    found = scored.join(spelt, "key").select("lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), "a", "worst.*")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 10),
inn AS (SELECT lang, g[1:2] AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM c WHERE k = 3),
most AS (SELECT lang, g, max(f) AS m FROM inn GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN most ON c.lang = most.lang AND c.g = most.g AND c.k = 2 WHERE m IS NULL OR 100 * m < 50 * c.f),
cut AS (SELECT lang, g, f AS a, unnest(range(1, k)) AS pos, k FROM kept),
s AS (SELECT cut.lang, cut.g, a, pos, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:pos] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[pos + 1:cut.k]),
worst AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, pos) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
