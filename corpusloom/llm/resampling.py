"""Resampling towards a target distribution by importance weights of hashed n-grams, in two Arrow passes.

Features of a text are its runs of 1 to `max_n` consecutive words (A-Z lower-cased; words are runs of ASCII letters
and digits and of all other characters beyond ASCII), joined by one space; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo `buckets`. In the first pass each partition counts its features by bucket (np.bincount) in one
vector, and treeReduce adds the vectors, once for the corpus and once for the target: no more than a few vectors of
`buckets` longs are ever in one place. A bucket's gain is the floored 1000-fold log ratio of its smoothed shares. In
the second pass the gains are broadcast (8 bytes a bucket), gathered by each feature's bucket and summed by document
(np.bincount with weights; exact up to 2^53); a document's weight is the floored mean.

Documents are drawn without replacement by Gumbel noise: the highest sums of weight and noise, the noise being a
function of seed and doc_id. Scores are whole numbers in a range that does not grow with the corpus (some 10^5
values at most), so their histogram gives the cut, and only what is at or above it is sorted: one range sort, whose
places within partitions and partition sizes give the ranks. No task ranks all rows, and rows that tie are spread.

Cases: null and empty texts have no features and weight 0; a null doc_id counts as an empty one for the noise and
comes last among ties; repeated rows each count, and are told apart by an arbitrary order where the cut falls between
them (their rows are equal, so the result is the same); ties go to the smaller doc_id; empty tables give empty results
and an empty target an even one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import materialise
from corpusloom.llm.textbytes import UPPER_TO_LOWER, pieces, runs
from corpusloom.session import table

MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words longer than this are hashed one by one.
LONG_WORD = 64
#: Features hashed at once.
BLOCK = 1 << 18


def _crc_table() -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, (table_ >> 1) ^ np.uint32(0xEDB88320), table_ >> 1).astype(np.uint32)
    return table_


_CRC = _crc_table()
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each slice of the bytes; with `before`, of what had that CRC, continued by the slice."""
    out = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]].tobytes(), int(out[k]))
    order = np.argsort(np.where(sizes > LONG_WORD, 0, sizes).astype(np.uint8), kind="stable")[::-1]
    short = sizes[order] <= LONG_WORD
    order = order[short]
    state, at = ~out[order], starts[order]
    longer = len(order) - np.cumsum(np.bincount(sizes[order], minlength=1)) if len(order) else np.zeros(1, np.int64)
    for j, n in enumerate(longer[:-1]):  # n slices have a byte j
        head = state[:n]
        state[:n] = _CRC[(head ^ data[at[:n] + j]) & 255] ^ (head >> np.uint32(8))
    out[order] = ~state
    return out


def _cut(max_n: int) -> np.ndarray | None:
    """Long texts are cut between words where no feature spans the cut."""
    return ~_IN_WORD if max_n == 1 else None


def features(data: np.ndarray, at: np.ndarray, max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the features of a piece, in blocks."""
    starts, ends = runs(_IN_WORD[data], at)
    low, sizes = UPPER_TO_LOWER[data], ends - starts
    text = np.searchsorted(at, starts, "right") - 1
    for a in range(0, len(starts), BLOCK):
        b, known = min(a + BLOCK, len(starts)), None
        for n in range(max_n):
            last = slice(a + n, min(b + n, len(starts)))
            count = last.stop - last.start
            if count <= 0:
                break
            known = known if known is None else crc32(np.array([32], np.uint8), np.zeros(count, np.int64), np.ones(count, np.int64), known[:count])
            known = crc32(low, starts[last], sizes[last], known)
            same = text[last] == text[a : a + count]
            yield text[a : a + count][same], (known[same] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """The features of a table of texts (column text) by bucket: one vector a partition, merged as a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at in pieces(batch.column(0), _cut(max_n)):
                for _, bucket in features(data, at, max_n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no partition
    return vectors.union(none).treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, by bucket."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n)))) for s, t in zip(corpus.astype(float), target.astype(float), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType
    key = to_arrow_type(kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            n = batch.num_rows
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for first, data, at in pieces(batch.column("text"), _cut(max_n)):
                here = slice(first, first + len(at) - 1)
                starts, _ = runs(_IN_WORD[data], at) if max_n > 1 else (None, None)
                for text, bucket in features(data, at, max_n, len(gain)):
                    count[here] += np.bincount(text, minlength=len(at) - 1)
                    total[here] += np.bincount(text, weights=gain[bucket], minlength=len(at) - 1)
                words[here] = count[here] if starts is None else np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=len(at) - 1)
            weight = np.rint(total).astype(np.int64) // np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(key), pa.array(words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(score, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the documents with at least min_words words, percent in a hundred (rounded down) with the highest scores are drawn.
    """
    gain = gains(bucket_counts(docs.select("text"), max_n, buckets), bucket_counts(target.select("text"), max_n, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = (F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))).cast("long")
    # The order of equal rows is written with them, so that it is the same whenever they are read.
    scored = materialise(weigh(docs, gain, max_n).select("*", score.alias("score"), F.xxhash64(F.monotonically_increasing_id()).alias("order")), "scored")
    may = F.col("n_words") >= min_words
    drawn, cut = 0, None
    counts = sorted(((r["score"], r["count"]) for r in scored.where(may).groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    for value, n in counts:
        if drawn >= wanted:
            break
        drawn, cut = drawn + n, value
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = may & (F.col("score") >= cut)
    ordered = scored.where(high).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), "order")
    # The id numbers the rows of a partition and holds the partition's number above them.
    ordered = materialise(ordered.select(*columns, F.monotonically_increasing_id().alias("place")), "drawn")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes, before, offsets = ordered.groupBy(part.alias("part")).count().collect(), 0, []  # a row a partition
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], before))
        before += r["count"]
    starts = docs.sparkSession.createDataFrame(offsets, "part long, start long")
    rank = F.col("start") + within + 1
    ranked = ordered.withColumn("part", part.cast("long")).join(F.broadcast(starts), "part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.union(scored.where(~F.coalesce(high, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's distribution, and its rank if it is drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLING_SQL = r"""
WITH steps AS (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM steps),
low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
flat AS (SELECT doc_id, unnest(words) AS word FROM low),
vocab AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT word FROM flat UNION ALL SELECT word FROM goal)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM vocab),
crc AS MATERIALIZED (SELECT word, xor(list_reduce([4294967295] || list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
s AS (SELECT bucket, count(*) AS n FROM flat JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN crc USING (word) GROUP BY 1),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS big_t),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + 10000) / ((s.n + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), tot),
per AS (SELECT doc_id, count(*)::BIGINT AS n, sum(g)::BIGINT AS total FROM flat JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1),
w AS (SELECT low.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight, ('0x' || substr(sha256('2024:' || low.doc_id), 1, 8))::BIGINT AS h
      FROM low LEFT JOIN per USING (doc_id)),
v AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS may FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS k, count(*) FILTER (may) OVER () AS many FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= 10 * many // 100 THEN k END::BIGINT AS rank FROM r"""
