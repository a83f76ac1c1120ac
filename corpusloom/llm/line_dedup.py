"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line (without surrounding ASCII white space, of at least `min_chars` characters: by default every line that
is not blank) is boilerplate if it stands on at least `min_sites` distinct sites. Sites are counted by HyperLogLog sketches per line hash, merged in the
map tasks and after the shuffle, so a line that a third of all documents hold costs a sketch per task.
Sketches are within `band` of the truth; lines whose estimate is that near to the threshold get exact
distinct counts (a two-step distinct aggregation). The first occurrence of a boilerplate line, by doc_id
and position, stays; all others are removed. Among different texts of one doc_id, a hash of the text decides.

Line hashes have 128 bits. The table of boilerplate lines is broadcast if its counted rows are within
the limit, else joined by shuffle, where AQE splits a hot line. Documents are joined to their flags by id.

Cases: null and empty texts have no lines that count and stay as they are; a null source is a site of its
own; a null doc_id never is the first occurrence unless no other is there; rows that repeat
doc_id and text are one document and treated alike (the flags go by doc_id and text hash); empty tables give empty results; other columns are
kept by the operator, except that n_lines and n_removed are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, materialise
from corpusloom.session import table

MIN_SITES, MIN_CHARS = 10, 1
_SPACE = " \t\r\x0b\x0c"
#: log2 of the sketch's registers (standard error 1.6 %) and the share of the threshold that counts as near.
LG_K, BAND = 12, 0.1


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(17), line).alias("_h2")]


def _lines(docs: DataFrame, site: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.coalesce(F.col(site), F.lit("\0")).alias("_site"), F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    bare = F.trim("_line", F.lit(_SPACE))
    return rows.select("_id", "_th", "_site", "_pos", *_key(bare), F.length(bare).alias("_n"))


def _occurrence() -> Column:
    """Where a line stands, in the order of occurrences."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("text"), F.col("_pos").alias("pos"))


def boilerplate(lines: DataFrame, min_sites: int, min_chars: int) -> DataFrame:
    """(_h1, _h2, first: the occurrence that stays) of the lines on at least min_sites sites."""
    long = lines.where(F.col("_n") >= min_chars)
    first = F.min(_occurrence()).alias("first")
    spread = long.groupBy("_h1", "_h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("sites"), first)
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    spread = materialise(spread.where(F.col("sites") >= low), "line-spread")
    near = spread.where(F.col("sites") <= high).select("_h1", "_h2")
    exact = long.join(broadcast_if_small(near), ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.countDistinct("_site").alias("exact"))
    sure = spread.where(F.col("sites") > high).select("_h1", "_h2", "first")
    return sure.union(spread.join(exact.where(F.col("exact") >= min_sites), ["_h1", "_h2"]).select("_h1", "_h2", "first"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines removed from text, and n_lines and n_removed (0 lines for a null text)."""
    lines = _lines(docs, site)
    found = materialise(boilerplate(lines, min_sites, min_chars), "boilerplate")
    here = _occurrence()
    marked = lines.select("_id", "_th", "_pos", F.when(F.col("_n") >= min_chars, F.col("_h1")).alias("_h1"), "_h2")
    marked = marked.join(broadcast_if_small(found), ["_h1", "_h2"], "left").select("_id", "_th", "_pos", (F.col("first").isNotNull() & (F.col("first") != here)).alias("_gone"))
    # One flag a line; of rows that repeat an id and text, the flags are equal, so distinct ones suffice.
    flags = marked.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.when(F.col("_gone"), F.col("_pos")))).alias("_at"), (F.max("_pos") + 1).alias("_count")).where(F.size("_at") > 0)
    # Dense flags make a line's lookup one step: gaps between removed positions become runs.
    previous = F.concat(F.array(F.lit(-1)), F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))))
    runs = F.flatten(F.zip_with("_at", previous, lambda a, p: F.concat(F.array_repeat(F.lit(False), a - p - 1), F.array(F.lit(True)))))
    flags = flags.select("_id", "_th", runs.alias("_flags"))
    # The documents' own columns travel in a struct, so their names clash with none here.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_own_th"), F.col("text").alias("_text"))
    joined = keyed.join(flags, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_th") == F.col("_th")), "left")
    split = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n")
    kept = F.array_join(F.filter(split, lambda _, i: ~F.coalesce(F.get("_flags", i), F.lit(False))), "\n")
    removed = F.coalesce(F.size(F.filter("_flags", lambda x: x)), F.lit(0))
    new_text = F.when(F.col("_flags").isNull(), F.col("_text")).otherwise(kept).alias("text")
    own = [new_text if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines")
    return joined.select(*own, n_lines, F.when(F.col("_flags").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after removal: lines, lines removed, and length and MD5 of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


def line_dedup_sql(documents: str = "documents", n: int = MIN_SITES, chars: int = MIN_CHARS) -> str:
    return f"""
WITH s AS (SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {documents}),
l AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM s),
b AS (SELECT bare, min(struct_pack(id := doc_id, pos := pos)) AS first FROM l WHERE length(bare) >= {chars} GROUP BY 1 HAVING count(DISTINCT site) >= {n}),
m AS (SELECT l.*, b.bare IS NOT NULL AND struct_pack(id := doc_id, pos := pos) <> b.first AS gone FROM l LEFT JOIN b ON l.bare = b.bare),
k AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_kept_chars, md5(text) AS kept_md5 FROM k"""
