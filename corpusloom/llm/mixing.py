"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule w(t) = weight * (1 + slope * (t - 1/2)) over training time t in
[0, 1]. Its integral over [0, 1] is the weight, its integral to t the share of the source's target that
is due by t. That cumulative demand is a quadratic, so it is inverted in closed form: the k-th word that
a source gives is due at a known t, and the documents, dealt in hashed order within their source, get
their training positions. Output is range-sorted by position.

Targets: sources in code-point order (null last) take the weights in turn and share `budget` of all
words; a source stops at `most` times its own words and the excess is shared again by weight
(water-filling: in the order of cap over weight, the first source whose cap reaches the level set by
the remaining budget fixes the level for it and all after it).

Scale: no per-source gathering. Documents fall in about sqrt(rows) hash buckets per source; offsets are
running sums over a source's buckets, then over a bucket's rows, so a source that holds a third of all
rows is spread over all tasks. Only the table of sources (one row each) is summed in one window.

Cases: null text has size 0 and is taken 0 words; null source is a source of its own, last; repeated
rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, materialise
from corpusloom.session import table

#: Slopes of the schedules, repeated over the sources as the weights are: rising, level, falling.
SLOPES = (1.0, 0.0, -1.0)
WEIGHTS = (3.0, 1.0, 2.0)
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words by ASCII white space, without an array of them (one character is left per word)."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{_BLANK}+\z", "")
    return F.length(F.regexp_replace(bare, rf"{_BLANK}*{_WORD}+", "x")).cast("long")


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, slope, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.select("source", "source_size", _cycle(weights, rank).alias("weight"), _cycle(slopes, rank).alias("slope"))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = W.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    per = per.withColumn("full_at", cap / F.col("weight"))
    left = F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(rest))
    # Sources fill up in this order until one does not; the level there is the highest of those that hold.
    level = F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(whole)
    return per.select("source", "source_size", "weight", "slope", F.least(cap, F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _due(words: Column) -> Column:
    """The t by which `words` of the source's target are due: the inverse of the integrated schedule."""
    u = F.least(F.greatest(words / F.col("target"), F.lit(0.0)), F.lit(1.0))
    b = F.lit(1.0) - F.col("slope") / 2
    return 2 * u / (b + F.sqrt(b * b + 2 * F.col("slope") * u))


def curriculum(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document with its size, its source's target, words taken and training positions.

    A source's documents are dealt in the order of md5(seed|doc_id) (a hash of the text where the id is null), again and again until its target
    is met; the last document of the last pass gives a part. taken: words given over all passes.
    position: the share of training at which the document is first read (null if never), repeat_position:
    at which its second pass begins (null if none). The result is range-sorted by position.
    """
    dealt = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text").cast("string")))))
    # Texts are read once: what follows needs their sizes only, in a table of some tens of bytes a row.
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), dealt.alias("dealt")), "sizes")
    n = sized.count()
    buckets = 1 << min(16, max(0, math.ceil(math.log2(max(1, n)) / 2)))
    bucket = F.floor(F.conv(F.substring("dealt", 1, 4), 16, 10).cast("long") / F.lit(65536 // buckets)).cast("int")
    sized = sized.withColumn("bucket", bucket)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    over = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start"))
    targets = source_targets(sums, weights, slopes, budget, most)
    targets = materialise(targets, "targets")
    starts = starts.join(broadcast_if_small(targets), starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("s"), starts["bucket"].alias("b"), "start", "source_size", "slope", "target")
    within = W.partitionBy("source", "bucket").orderBy("dealt", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(F.col("s")) & (placed["bucket"] == F.col("b")))
    before, goal = F.col("start") + F.col("inner"), F.floor("target")
    part = lambda k: F.least(F.greatest(goal - k * F.col("source_size") - before, F.lit(0)), F.col("size"))
    passes = [part(k) for k in range(math.ceil(most))]
    at = lambda k: F.when(passes[k] > 0, _due(before + k * F.col("source_size")))
    out = placed.select("doc_id", "size", "source_size", F.col("source"), "target", sum(passes[1:], passes[0]).cast("long").alias("taken"), at(0).alias("position"), (at(1) if most > 1 else F.lit(None).cast("double")).alias("repeat_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sizes, targets and words taken, in training order."""
    out = curriculum(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"), F.round("repeat_position", 9).alias("repeat_position"))


def mixing_sql(documents: str = "documents") -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS dealt,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {documents}),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][r % 3 + 1] AS weight, [1.0::DOUBLE, 0.0, -1.0][r % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS cap FROM per),
lv AS (SELECT *, cap / weight AS full_at,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, least(cap, coalesce(max(level) FILTER (full_at >= level) OVER (), 0) * weight) AS target FROM lv),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.slope,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.dealt, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, least(greatest(floor(target)::BIGINT - before, 0), size) AS one, least(greatest(floor(target)::BIGINT - source_size - before, 0), size) AS two,
         least(greatest(before / target, 0), 1) AS u, least(greatest((before + source_size) / target, 0), 1) AS v, 1 - slope / 2 AS b FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN round(2 * u / (b + sqrt(b * b + 2 * slope * u)), 9) END AS position,
       CASE WHEN two > 0 THEN round(2 * v / (b + sqrt(b * b + 2 * slope * v)), 9) END AS repeat_position
FROM q"""
