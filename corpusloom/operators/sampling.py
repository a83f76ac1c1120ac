"""Sampling, splitting, mixing and selection. Random order is the order of md5(seed|key): the same on
every engine, partitioning and retry. Exact counts come from two-level ranks (with_rank).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import ordered


def hashed(seed: object, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def with_rank(df: DataFrame, order: list[Column], name: str = "rank", buckets: int = 256, uniform: bool = False) -> DataFrame:
    """df with the 0-based global rank by `order`. uniform: it begins with a hash, so its keys have no common beginning.

    Rows fall in buckets that follow the order (three characters of a string key after what all keys begin
    with, quantile cuts of a number); a rank is the bucket's offset plus the row's place in its bucket, so no
    task ranks all rows and the result does not hang on how rows are partitioned.
    """
    cols = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns(cols)
    if dict(keyed.dtypes)["_o0"] == "string":
        low, high = ("", "") if uniform else keyed.agg(F.min("_o0"), F.max("_o0")).first()
        same = len(os.path.commonprefix([low or "", high or ""]))
        bucket = F.coalesce(F.substring("_o0", same + 1, 3), F.lit(""))
    else:
        cuts = keyed.agg(F.percentile_approx("_o0", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
        bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("_o0"))), F.lit(-1)) if cuts else F.lit(0)
    keyed = keyed.withColumn("_b", bucket)
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(*cols)) - 1
    # The window has dealt the rows by bucket, so the join moves only the offsets; Spark broadcasts them if they are few.
    return keyed.withColumn("_place", place).join(offsets, "_b").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_b", "_before", "_place", *cols)


def sample(df: DataFrame, n: int, key: str, seed: object = 42, shuffle: bool = True) -> DataFrame:
    """n rows: whole copies of df, then the first of the (hashed) order."""
    total = df.count()
    tiles, rest = divmod(n, total) if total else (0, 0)
    order = [hashed(seed, key), F.col(key)] if shuffle else [F.col(key)]
    out = df.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(tiles)))).drop("_t") if tiles else df.limit(0)
    return out.unionByName(df.orderBy(*order).limit(rest)) if rest else out


def calibration_windows(df: DataFrame, key: str, ids: str, length: int, n: int, seed: object = 42) -> DataFrame:
    """(key, start, ids): n sequences of `length` tokens, each from a random place of one of the first n rows, in hashed order, that are long enough."""
    chosen = df.where(F.size(ids) >= length).select(F.col(key), F.size(ids).alias("_n")).orderBy(hashed(seed, key), key).limit(n)
    number = F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("long")
    placed = chosen.select(F.col(key).alias("_k"), (number % (F.col("_n") - length + 1)).alias("start"))
    found = df.join(F.broadcast(placed), F.col(key) == F.col("_k"))  # n rows
    return found.select(key, "start", F.slice(ids, F.col("start").cast("int") + 1, F.lit(length)).alias(ids))


def split_sizes(length: int, ratio: float, n: int | None = None) -> tuple[int, int]:
    """(train, val) rows: val = max(int(min(length, n) * ratio), 1), train the rest of n."""
    n = length if n is None else n
    if ratio == 0:
        return n, 0
    if ratio == 1:
        if n > length:
            raise ValueError("the validation set takes no row twice")
        return 0, n
    val = max(int(min(length, n) * ratio), 1)
    if n - val <= 0:
        raise ValueError("no training rows are left")
    return n - val, val


def train_val_split(df: DataFrame, ratio: float, key: str, n: int | None = None, seed: object = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, with exact counts; training rows are drawn again from what validation leaves."""
    train, val = split_sizes(df.count(), ratio, n)
    ranked = with_rank(df, [hashed(seed, key), F.col(key)], "_rank", uniform=True)
    rest = ranked.where(F.col("_rank") >= val).drop("_rank")
    return sample(rest, train, key, seed) if train else df.limit(0), ranked.where(F.col("_rank") < val).drop("_rank")


def stream_split(df: DataFrame, n: int, ratio: float, key: str) -> tuple[DataFrame, DataFrame]:
    """Of the first n rows by key the first int(n * ratio) are validation, the others training."""
    val = int(n * ratio)
    ranked = with_rank(df, [F.col(key)], "_rank").where(F.col("_rank") < n)
    return ranked.where(F.col("_rank") >= val).drop("_rank"), ranked.where(F.col("_rank") < val).drop("_rank")


def shuffled(df: DataFrame, key: str, seed: object = 42) -> DataFrame:
    return df.orderBy(hashed(seed, key), F.col(key))


def interleave(frames: list[DataFrame], probabilities: list[float], key: str, seed: object = 42, stop: str = "first_exhausted") -> DataFrame:
    """Rows of all frames by (place + 1) / probability, cut where the first (or last) frame runs out.

    all_exhausted repeats the shorter frames until the longest (by place over probability) is done.
    """
    counts = [f.count() for f in frames]
    ends = [c / p for c, p in zip(counts, probabilities, strict=True)]
    cut = min(ends) if stop == "first_exhausted" else max(ends)
    out = None
    for i, (f, p, c) in enumerate(zip(frames, probabilities, counts, strict=True)):
        ranked = with_rank(f, [hashed(seed, key), F.col(key)], "_rank", uniform=True)
        if stop != "first_exhausted" and c:
            tiles = int(-(-cut * p // c))
            ranked = ranked.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(max(tiles, 1) - 1)))).withColumn("_rank", F.col("_rank") + F.col("_t") * c).drop("_t")
        part = ranked.select("*", ((F.col("_rank") + 1) / F.lit(p)).alias("mix_order"), F.lit(i).alias("mix_source")).where(F.col("mix_order") <= cut + 1e-9).drop("_rank")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def per_category(df: DataFrame, category: str, n: int, key: str, seed: object = 42, fits: Column | None = None) -> DataFrame:
    """n rows of each category without replacement, those that do not fit skipped; one pass over all categories."""
    rows = df if fits is None else df.where(fits)
    w = W.partitionBy(category).orderBy(hashed(seed, key), F.col(key))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def piece(df: DataFrame, i: int, n: int, key: str) -> DataFrame:
    """Contiguous piece i of n; each has length // n rows, the tail goes."""
    size = df.count() // n
    return with_rank(df, [F.col(key)], "_rank").where((F.col("_rank") >= i * size) & (F.col("_rank") < (i + 1) * size)).drop("_rank")


def with_shard(df: DataFrame, key: str, world: int, drop_last: bool = True) -> DataFrame:
    """df with `shard` (strided); with drop_last all shards are equally long, else the first rows come again."""
    total = df.count()
    ranked = with_rank(df, [F.col(key)], "idx")
    if drop_last:
        ranked = ranked.where(F.col("idx") < total // world * world)
    else:
        missing = -total % world
        ranked = ranked.unionByName(ranked.where(F.col("idx") < missing).withColumn("idx", F.col("idx") + total))
    return ranked.withColumn("shard", F.pmod("idx", F.lit(world)))


def length_grouped(df: DataFrame, key: str, length: str, batch: int, seed: object = 42) -> DataFrame:
    """df with `place`: hashed order cut into mega-batches, each sorted by length, longest first."""
    ranked = with_rank(df, [hashed(seed, key), F.col(key)], "_r", uniform=True).withColumn("mega", F.floor(F.col("_r") / batch))
    w = W.partitionBy("mega").orderBy(F.col(length).desc(), F.col(key))
    return ranked.withColumn("place", F.col("mega") * batch + F.row_number().over(w) - 1).drop("_r")


def linspace_part(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df with `part`: contiguous cuts at int(i * total / parts)."""
    total = df.count()
    cuts = [int(i * total / parts) for i in range(parts + 1)]
    part = F.lit(parts - 1)
    for i in range(parts - 2, -1, -1):
        part = F.when(F.col("_rank") < cuts[i + 1], i).otherwise(part)
    return with_rank(df, [F.col(key)], "_rank").withColumn("part", part.cast("long")).drop("_rank")


def even_part(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df with `part`: contiguous, the first total % parts one row longer."""
    size, extra = divmod(df.count(), parts)
    edge = extra * (size + 1)
    r = F.col("_rank")
    part = F.when(r < edge, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - edge) / max(size, 1)))
    return with_rank(df, [F.col(key)], "_rank").withColumn("part", part.cast("long")).drop("_rank")


def round_robin(df: DataFrame, key: str, parts: int) -> DataFrame:
    return with_rank(df, [F.col(key)], "_rank").withColumn("part", F.pmod("_rank", F.lit(parts))).drop("_rank")


def valid_top_up(df: DataFrame, valid: Column, n: int, key: str, seed: object = 42) -> DataFrame:
    """n valid rows in hashed order: rows that fail are replaced by the next ones, not tried again."""
    return df.where(valid).orderBy(hashed(seed, key), F.col(key)).limit(n)


def fit_negatives(negatives: Column, n: int, seed: Column) -> Column:
    """An array of exactly n items: the first n, or filled up by hashed picks; null if there are none."""
    pick = lambda i: F.element_at(negatives, (F.pmod(F.xxhash64(seed, i), F.size(negatives).cast("long")) + 1).cast("int"))
    fill = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.size(negatives), F.get(negatives, i - 1)).otherwise(pick(i)))
    return F.when(F.size(negatives) > 0, fill)


def rerank_samples(df: DataFrame, query: str, label: str, key: str, positives: int, negatives: int) -> DataFrame:
    """Up to `positives` positives of each query, each with up to `negatives` negatives, in key order."""
    w = W.partitionBy(query, label).orderBy(key)
    ranked = df.withColumn("_k", F.row_number().over(w))
    pos = ranked.where((F.col(label) == 1) & (F.col("_k") <= positives)).select(query, F.col(key).alias("positive"))
    neg = ranked.where((F.col(label) == 0) & (F.col("_k") <= negatives)).groupBy(query).agg(F.sort_array(F.collect_list(key)).alias("negatives"))
    return pos.join(neg, query, "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<bigint>")))


def smallest_per_group(df: DataFrame, group: str, value: str, key: str, k: int) -> DataFrame:
    """The k smallest of each group; null values (super rows) never."""
    w = W.partitionBy(group).orderBy(F.col(value).asc_nulls_last(), F.col(key))
    return df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= k) & F.col(value).isNotNull()).drop("_k")


def exact_quantile(df: DataFrame, value: str, share: float, by: list[str], name: str) -> DataFrame:
    """(by..., name): the quantile by linear interpolation, exact, null for groups without values.

    Without groups the value is selected in rounds over all tasks (ordered.select). Within groups an approximate
    quantile just below and one just above bracket it; only what lies between them (some thousandths of the rows)
    is counted by value and ordered, so no task holds all distinct values.
    """
    if not by:
        return df.sparkSession.createDataFrame([(ordered.quantile(df, value, share),)], f"{name} double")
    rows = df.select(*by, F.col(value).alias("_x")).where("_x IS NOT NULL")
    edge = lambda q, end: end("_x") if not 0.002 < q < 0.998 else F.percentile_approx("_x", F.lit(q), F.lit(10_000))
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), edge(share - 0.001, F.min).alias("_low"), edge(share + 0.001, F.max).alias("_high"))
    near = rows.join(ends, by)
    below = F.count_if(F.col("_x") < F.col("_low")).alias("_below")
    base = near.groupBy(*by, "_n").agg(below)
    steps = near.where(F.col("_x").between(F.col("_low"), F.col("_high"))).groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    steps = steps.join(base, by)
    end = F.col("_below") + F.sum("_c").over(W.partitionBy(*by).orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    at = F.lit(share) * (F.col("_n") - 1)
    holds = lambda k: F.max(F.when((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")), F.col("_x")))
    placed = steps.withColumn("_end", end).withColumn("_k", F.floor(at)).withColumn("_f", at - F.floor(at))
    found = placed.groupBy(*by).agg(holds(F.col("_k")).alias("_a"), holds(F.least(F.col("_k") + 1, F.col("_n") - 1)).alias("_z"), F.max("_f").alias("_f"))
    return found.select(*by, (F.col("_a") + F.col("_f") * (F.col("_z") - F.col("_a"))).alias(name))


def super_rows(df: DataFrame, value: str, layer: str, share: float = 0.995, fraction: float = 0.75) -> DataFrame:
    """Rows above both the exact quantile and a tenth of the maximum, in the first part of the layers."""
    n = F.count_distinct(layer)
    cut = df.agg((F.max(value) / 10).alias("_tenth"), (F.min(layer) + F.floor(n * fraction)).alias("_last")).crossJoin(exact_quantile(df, value, share, [], "_q"))
    cut = cut.select(F.greatest("_q", "_tenth").alias("_cut"), "_last")  # one row
    return df.crossJoin(F.broadcast(cut)).where((F.col(value) > F.col("_cut")) & (F.col(layer) < F.col("_last"))).drop("_cut", "_last")


def best_of_n(df: DataFrame, prompt: str, choice: str, orm: str, prm: str, n_best: int, valid: str) -> DataFrame:
    """(prompt, choice, rejected): the n_best by prm + 10 orm that are valid, against the worst of the prompt."""
    score = F.col(prm) + 10 * F.col(orm)
    best, worst = W.partitionBy(prompt).orderBy(score.desc(), F.col(choice).desc()), W.partitionBy(prompt).orderBy(score, F.col(choice))
    rows = df.select(prompt, choice, valid, F.row_number().over(best).alias("_b"), F.first(choice).over(worst).alias("rejected"))
    return rows.where((F.col("_b") <= n_best) & F.col(valid) & (F.col(choice) != F.col("rejected"))).select(prompt, choice, "rejected")


def dominant(df: DataFrame, layer: str, value: str, key: str, n: int) -> DataFrame:
    """The best of each layer, then the best of the rest over all layers, n rows in all."""
    top = df.withColumn("_k", F.row_number().over(W.partitionBy(layer).orderBy(F.col(value).desc(), F.col(key))))
    ranked = top.orderBy(F.when(F.col("_k") == 1, 0).otherwise(1), F.col(value).desc(), F.col(layer), F.col(key))
    return ranked.limit(n).drop("_k")
