"""Sources, sinks, packing and streaming over the driver's tables, through files in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import packing
from corpusloom.operators.ordered import running
from corpusloom.plans.registry import query, r6
from corpusloom.session import scratch_dir, table
from corpusloom.sources import files
from corpusloom.streaming import streams


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("src05_csv_scan", "SELECT c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS note FROM customer")
def _(s, d):
    """Empty cells stay empty text."""
    path = scratch_dir(s, "csv") + "/t.csv"
    table(s, d, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x").alias("note")).write.option("header", True).option("emptyValue", "").csv(path)
    return files.read_file(s, path)


@query("src06_split_folder", "SELECT doc_id, lang FROM documents")
def _(s, d):
    """Two splits of a folder, read and concatenated."""
    base = scratch_dir(s, "splits")
    for k, name in enumerate(("train", "validation")):
        docs(s, d).where(F.col("doc_id") % 2 == k).select("doc_id", "lang").write.parquet(f"{base}/{name}.parquet")
    return files.concat([files.read_file(s, f"{base}/{n}.parquet") for n in ("train", "validation")])


@query("src09_load_dataset", "SELECT 'user' AS role, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'assistant', 'ok' FROM conversations WHERE role = 'user'")
def _(s, d):
    """A JSONL file in query/response layout, loaded by reference and split; both parts together give all rows."""
    from corpusloom.plans.loader import load_dataset

    path = scratch_dir(s, "load").removeprefix("file://")
    rows = table(s, d, "conversations").where("role = 'user'").select(F.col("text").alias("query"), F.lit("ok").alias("response"))
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/train.jsonl")
    train, val = load_dataset(s, path, split_dataset_ratio=0.2)
    both = train.unionByName(val)
    return both.select(F.explode("messages").alias("m")).select("m.role", F.col("m.content").alias("text"))


@query("src15_jsonl_round_trip", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(s, d):
    path = scratch_dir(s, "jsonl") + "/t.jsonl"
    files.write_jsonl(docs(s, d), path)
    return files.read_file(s, path, "doc_id bigint, lang string, source string, n_chars bigint")


@query("src17_rectangular", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def _(s, d):
    df = docs(s, d)
    return files.concat([df.where("doc_id % 2 = 0").select("doc_id", "lang"), df.where("doc_id % 2 = 1").select("doc_id")])


@query("src18_batched_rows", "SELECT doc_id, lang FROM documents")
def _(s, d):
    b = files.batched(docs(s, d).select("doc_id", "lang"), F.col("doc_id"), 100)
    return files.unbatched(b, ["doc_id", "lang"])


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("lengths"))


@query("src19_cached_sink", "SELECT conv_id % 5 = 0 AS val, conv_id, sum(length(text))::BIGINT AS total FROM conversations GROUP BY conv_id")
def _(s, d):
    """Training and validation rows in folders of their own, read back as written."""
    base = scratch_dir(s, "cache")
    for val in (False, True):
        files.cached(_lengths(s, d).where((F.col("conv_id") % 5 == 0) == val), f"{base}/{'val' if val else 'train'}")
    rows = [s.read.parquet(f"{base}/{name}").withColumn("val", F.lit(name == "val")) for name in ("train", "val")]
    return rows[0].unionByName(rows[1]).select("val", "conv_id", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("src20_cached_source", "WITH c AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(length(text)) <= 900) SELECT conv_id FROM c ORDER BY md5('42|' || conv_id::VARCHAR), conv_id LIMIT 8")
def _(s, d):
    """Rows that are short enough, of which a number is sampled (the feature)."""
    path = scratch_dir(s, "cache") + "/c.parquet"
    files.cached(_lengths(s, d), path)
    return files.read_cached(s, path, "conv_id", max_length=900, sample=8).select("conv_id")


@query("src21_row_slice", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 100)")
def _(s, d):
    return files.row_slice(docs(s, d), "doc_id", [3, 5, 8, 100]).select("doc_id", "lang")


@query("src25_report_rows", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def _(s, d):
    return docs(s, d).groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("n_chars"), "mean"))


@query("src26_report_union", "SELECT source, count(*) AS n, NULL::DOUBLE AS baseline FROM documents GROUP BY source UNION ALL SELECT 'base', NULL, 1.5::DOUBLE")
def _(s, d):
    a = docs(s, d).groupBy("source").agg(F.count("*").alias("n"))
    base = docs(s, d).limit(1).select(F.lit("base").alias("source"), F.lit(1.5).alias("baseline"))
    return files.concat([a, base])


@query("src27_modality", "WITH p AS (SELECT doc_id, ['PNG', 'mp4', 'wav', 'jpeg', 'MKV', 'flac', 'webp', 'avi'][(doc_id * 5 + n_chars) % 8 + 1] AS x FROM documents) SELECT doc_id, CASE WHEN lower(x) IN ('png', 'jpeg', 'webp') THEN 'image' WHEN lower(x) IN ('wav', 'flac') THEN 'audio' ELSE 'video' END AS modality FROM p")
def _(s, d):
    from corpusloom.functions.text import modality

    names = F.array(*[F.lit(x) for x in ("PNG", "mp4", "wav", "jpeg", "MKV", "flac", "webp", "avi")])
    path = F.concat(F.lit("a.mp3/"), "source", F.lit("."), F.element_at(names, ((F.col("doc_id") * 5 + F.col("n_chars")) % 8 + 1).cast("int")))
    return docs(s, d).select("doc_id", modality(path).alias("modality"))


@query("src28_redact", "SELECT doc_id, NULL::VARCHAR AS hub_token, n_chars AS max_tokens, CASE WHEN lang = 'en' THEN '<<<bytes>>>' END AS blob, source AS kept, NULL::VARCHAR AS inner_token, lang AS inner_name FROM documents")
def _(s, d):
    """Token texts and bytes go, also in a struct; numbers, nulls and other names stay."""
    from corpusloom.operators.normalise import redact

    inner = F.struct(F.col("source").alias("api_token"), F.col("lang").alias("name")).alias("inner")
    x = redact(docs(s, d).select("doc_id", F.col("lang").alias("hub_token"), F.col("n_chars").alias("max_tokens"), F.when(F.col("lang") == "en", F.col("source").cast("binary")).alias("blob"), F.col("source").alias("kept"), inner))
    return x.select("doc_id", "hub_token", "max_tokens", "blob", "kept", F.col("inner.api_token").alias("inner_token"), F.col("inner.name").alias("inner_name"))


@query("src30_preview", "SELECT event_id, round(value / 3, 4) AS reward FROM events ORDER BY event_id LIMIT 10")
def _(s, d):
    e = table(s, d, "events").select("event_id", (F.col("value") / 3).alias("reward"))
    return files.preview(e, ["event_id", "reward"], 10, ["event_id"])


def _packs_sql(length: str, shards: str) -> str:
    """Best fit, largest first, as a fold over each shard's rows: the fullest bin that holds a row takes it."""
    best = "list_position(a.rooms, list_min([r FOR r IN a.rooms IF r >= x.size]))"
    put = f"CASE WHEN {best} IS NULL THEN list_append(a.rooms, 8192 - x.size) ELSE [CASE WHEN i = {best} THEN a.rooms[i] - x.size ELSE a.rooms[i] END FOR i IN range(1, len(a.rooms) + 1)] END"
    took = f"list_append(a.bins, coalesce({best}, len(a.rooms) + 1)::BIGINT)"
    return f"""WITH r AS (SELECT doc_id, {length} AS n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % ({shards}) AS shard FROM documents),
 g AS (SELECT shard, list(doc_id ORDER BY n DESC, doc_id) AS ids, list({{'rooms': []::BIGINT[], 'bins': []::BIGINT[], 'size': n::BIGINT}} ORDER BY n DESC, doc_id) AS items FROM r GROUP BY shard),
 p AS (SELECT shard, ids, list_reduce(items, lambda a, x: {{'rooms': {put}, 'bins': {took}, 'size': 0::BIGINT}}, {{'rooms': []::BIGINT[], 'bins': []::BIGINT[], 'size': 0::BIGINT}}).bins AS bins FROM g)
 SELECT shard, unnest(ids) AS doc_id, unnest(bins) - 1 AS pack_id FROM p"""


@query("pck01_bin_packing", _packs_sql("n_chars", "(SELECT greatest(1, (count(*) + 99999) // 100000) FROM documents)"))
def _(s, d):
    """The pack of every row; as many shards as hold some rows each."""
    return packing.pack(docs(s, d), "doc_id", F.col("n_chars"), 8192).select("shard", "doc_id", "pack_id")


@query("pck02_sharded_packing", _packs_sql("(n_chars + doc_id % 100)", "4"))
def _(s, d):
    """Rows of two lengths count with their sum; four shards are packed apart."""
    rows = docs(s, d).withColumn("lengths", F.array("n_chars", F.col("doc_id") % 100))
    return packing.pack(rows, "doc_id", F.col("lengths"), 8192, shards=4).select("shard", "doc_id", "pack_id")


_TOKENS = r"regexp_extract_all(text, '[^ \t\n\r\x0b\f]+')"


@query("pck04_pack_concat", f"""WITH k AS ({_packs_sql(f"len({_TOKENS})", "4")}), j AS (SELECT k.shard, k.pack_id, d.doc_id, {_TOKENS} AS w FROM k JOIN documents d USING (doc_id))
 SELECT shard, pack_id, md5(string_agg(array_to_string(w, ' '), ' ' ORDER BY len(w) DESC, doc_id) FILTER (len(w) > 0)) AS ids, sum(len(w))::BIGINT AS n_ids, sum(len(w) * (len(w) - 1) // 2)::BIGINT AS positions FROM j GROUP BY ALL""")
def _(s, d):
    from corpusloom.functions.text import words

    rows = table(s, d, "documents").select("doc_id", "n_chars", words(F.col("text")).alias("ids"))
    p = packing.concatenated(packing.pack(rows, "doc_id", F.size("ids"), 8192, shards=4), rows, "doc_id", "ids")
    ids = F.when(F.size("ids") > 0, F.md5(F.array_join("ids", " "))).alias("ids")
    return p.select("shard", "pack_id", ids, F.size("ids").cast("long").alias("n_ids"), F.aggregate("positions", F.lit(0).cast("long"), lambda t, x: t + x).alias("positions"))


@query("pck05_sequential_fill", "WITH a AS (SELECT doc_id, n_chars, lang, coalesce(sum(n_chars + 1) OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM documents) SELECT doc_id, lang AS shard, p // 4096 AS sample, p % 4096 AS start, least(n_chars, 4096 - p % 4096) AS taken FROM a")
def _(s, d):
    from corpusloom.operators.sampling import hashed

    return packing.sequential_fill(docs(s, d), "doc_id", "n_chars", 4096, hashed(1, "doc_id"), F.col("lang"))


def _event_files(s: SparkSession, d: str) -> str:
    path = scratch_dir(s, "stream") + "/in"
    e = table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path


_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@query("str01_stream_load", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def _(s, d):
    """A file stream as it comes, to Parquet by batch."""
    base = scratch_dir(s, "load")
    src = streams.file_stream(s, _event_files(s, d), _EVENT, "parquet", 1)
    streams.run_available(src, lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}"), f"{base}/check")
    return s.read.parquet(f"{base}/out").select("event_id", "user_id", "event_type", r6("value", "value"))


@query("str02_stream_map", "SELECT event_id, md5('user:' || event_type || '|assistant:' || user_id) AS m FROM events")
def _(s, d):
    """The expressions of a batch on a stream, in small batches: rows become messages."""
    from corpusloom.functions.messages import message

    base = scratch_dir(s, "map")
    src = streams.file_stream(s, _event_files(s, d), _EVENT, "parquet", 1)
    m = src.select("event_id", F.array(message("user", F.col("event_type")), message("assistant", F.col("user_id").cast("string"))).alias("messages"))
    streams.run_available(m, lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}"), f"{base}/check")
    return s.read.parquet(f"{base}/out").select("event_id", F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("m"))


@query("str08_resumable_sink", "SELECT event_id, round(value, 6) AS value FROM events WHERE event_type = 'purchase'")
def _(s, d):
    """File stream, mapped and filtered, to JSON lines by batch; run twice, the second run finds nothing new."""
    base = scratch_dir(s, "sink")
    src = streams.file_stream(s, _event_files(s, d), _EVENT, "parquet", 2).where("event_type = 'purchase'").select("event_id", F.round("value", 6).alias("value"))
    for _ in range(2):
        streams.run_available(src, streams.append_jsonl(f"{base}/out"), f"{base}/check")
    return s.read.schema("event_id bigint, value double").json(f"{base}/out").select("event_id", "value")


@query("str03_take_skip", "SELECT event_id FROM events ORDER BY event_id LIMIT 500 OFFSET 100")
def _(s, d):
    base = scratch_dir(s, "take")
    src = streams.file_stream(s, _event_files(s, d), _EVENT, "parquet", 1).select("event_id")
    path = _event_files(s, d)
    # One file, so that the order of files is that of the rows.
    s.read.parquet(path).orderBy("event_id").coalesce(1).write.parquet(base + "/one")
    src = streams.file_stream(s, base + "/one", _EVENT, "parquet", 1).select("event_id")
    streams.run_available(src, streams.take_skip(src, "event_id", 100, 500, f"{base}/out"), f"{base}/check")
    return s.read.parquet(f"{base}/out/rows").select("event_id")


@contextmanager
def _started(out: DataFrame, base: str) -> Iterator[StreamingQuery]:
    """A running query that writes each micro-batch to a folder of its own, from the checkpoint in `base` on."""
    sink = out.writeStream.outputMode("append").option("checkpointLocation", base + "/check").trigger(processingTime="100 milliseconds")
    query = sink.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).start()
    try:
        yield query
    finally:
        query.stop()


_BUFFER = 64


def _buffer_sql() -> str:
    """Each lane as a fold over its rows: a full buffer lets a random row go for the one that comes; what is left goes last."""
    slot = f"(('0x' || substr(md5('42|' || x.lane || '|' || (a.came)), 1, 8))::BIGINT % {_BUFFER} + 1)"
    full = f"len(a.buf) >= {_BUFFER}"
    buf = f"CASE WHEN {full} THEN list_concat(a.buf[:{slot} - 1], [x.id], a.buf[{slot} + 1:]) ELSE list_append(a.buf, x.id) END"
    out = f"CASE WHEN {full} THEN list_append(a.out, a.buf[{slot}]) ELSE a.out END"
    zero = "{'lane': 0::BIGINT, 'id': 0::BIGINT, 'came': 0::BIGINT, 'buf': []::BIGINT[], 'out': []::BIGINT[]}"
    return f"""WITH g AS (SELECT event_id % 4 AS lane, list({{'lane': (event_id % 4)::BIGINT, 'id': event_id, 'came': 0::BIGINT, 'buf': []::BIGINT[], 'out': []::BIGINT[]}} ORDER BY event_id) AS items FROM events GROUP BY 1),
 f AS (SELECT lane, list_reduce(items, lambda a, x: {{'lane': x.lane, 'id': 0::BIGINT, 'came': a.came + 1, 'buf': {buf}, 'out': {out}}}, {zero}) AS r FROM g),
 l AS (SELECT lane, r.out AS gone, [x.id FOR x IN list_sort([{{'h': md5('42|' || lane || '|slot|' || (i - 1)), 'id': r.buf[i]}} FOR i IN range(1, len(r.buf) + 1)])] AS rest FROM f)
 SELECT lane::BIGINT AS lane, unnest(range(len(gone) + len(rest)))::BIGINT AS place, unnest(list_concat(gone, rest)) AS event_id FROM l"""


@query("str04_buffer_shuffle", _buffer_sql())
def _(s, d):
    """Four lanes with a buffer each, over files that come while the query runs, and a second run that goes on from its checkpoint
    and flushes; the order in which rows leave."""
    base = scratch_dir(s, "shuffle")
    rows = table(s, d, "events").select((F.col("event_id") % 4).alias("lane"), F.col("event_id").alias("key"), F.col("event_type").alias("row"))
    cuts = rows.agg(F.percentile_approx("key", [0.3, 0.7, 1.0])).first()[0]

    def arrive(low: int | None, high: int) -> int:
        part = rows.where((F.col("key") <= high) & (F.lit(True) if low is None else F.col("key") > low))
        part.coalesce(1).write.mode("append").parquet(base + "/in")  # one file, so that a batch holds all of it
        return part.count()

    def start(idle: int | None):  # noqa: ANN202
        src = streams.file_stream(s, base + "/in", "lane bigint, key bigint, row string", "parquet", 1000)
        return _started(streams.buffer_shuffle(src, _BUFFER, 42, idle), base)

    def run() -> DataFrame:
        rows.limit(0).write.parquet(base + "/in")
        with start(None) as query:
            first = arrive(None, cuts[0])
            streams.run_until(query, lambda n, _: n >= first)
            second = arrive(cuts[0], cuts[1])
            streams.run_until(query, lambda n, _: n >= first + second)
        last = arrive(cuts[1], cuts[2])
        with start(500) as query:
            streams.run_until(query, lambda n, left: n >= last and not left)
        return s.read.parquet(base + "/out").select("lane", "place", F.col("key").alias("event_id"))

    return _with_rocksdb(s, run)


@query("str07_incremental_means", "SELECT event_type, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS mean, sum(user_id % 7 + 1)::BIGINT AS count FROM events GROUP BY event_type")
def _(s, d):
    base = scratch_dir(s, "means")
    src = streams.file_stream(s, _event_files(s, d), _EVENT, "parquet", 2).withColumn("n", F.col("user_id") % 7 + 1)
    streams.run_available(streams.running_means(src, "event_type", "value", "n"), lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/check", "complete")
    return s.read.parquet(f"{base}/out").select("event_type", r6("mean", "mean"), "count")


@query("str10_windowed_stats", """WITH p AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, arg_max(event_id % 100, event_id) AS p, arg_max(event_id % 17, event_id) AS g FROM events GROUP BY ALL)
 SELECT strftime(start, '%Y-%m-%d') AS day, sum(p)::BIGINT AS num_prompt_tokens, sum(g)::BIGINT AS num_generated_tokens, count(*) AS num_samples FROM p GROUP BY start""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100).alias("p"), (F.col("event_id") % 17).alias("g"))
    out = streams.windowed_stats(e, "ts", "user_id", "event_id", "p", "g", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "num_prompt_tokens", "num_generated_tokens", "num_samples")


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_rocksdb(s: SparkSession, run):
    """Runs with the state store that stateful pandas processors need, and puts the setting back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, _ROCKS)
    try:
        return run()
    finally:
        if before is None:
            s.conf.unset(key)
        else:
            s.conf.set(key, before)


def _stream_packs_sql(step: str) -> str:
    """Packs of two shards as a recursion over steps: what a step brings is packed with the last bin of the step before."""
    best = "list_position(a.rooms, list_min([r FOR r IN a.rooms IF r >= x.size]))"
    put = f"CASE WHEN {best} IS NULL THEN list_append(a.rooms, 8192 - x.size) ELSE [CASE WHEN i = {best} THEN a.rooms[i] - x.size ELSE a.rooms[i] END FOR i IN range(1, len(a.rooms) + 1)] END"
    took = f"list_append(a.bins, coalesce({best}, len(a.rooms) + 1)::BIGINT)"
    zero = "{'rooms': []::BIGINT[], 'bins': []::BIGINT[], 'size': 0::BIGINT}"
    bins = f"list_reduce([{{'rooms': []::BIGINT[], 'bins': []::BIGINT[], 'size': -i.neg}} FOR i IN items], lambda a, x: {{'rooms': {put}, 'bins': {took}, 'size': 0::BIGINT}}, {zero}).bins"
    return f"""WITH RECURSIVE r AS (SELECT doc_id % 2 AS shard, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS index FROM documents),
 g AS (SELECT shard, {step} AS k, list({{'neg': -n_chars, 'id': doc_id}}) AS items FROM r GROUP BY 1, 2),
 s AS (SELECT shard, k, items, {bins} AS bins, 0::BIGINT AS done FROM (SELECT shard, k, list_sort(items) AS items FROM g WHERE k = 0)
  UNION ALL SELECT shard, k, items, {bins} AS bins, done FROM (SELECT s.shard, g.k, s.done + list_max(s.bins) - 1 AS done,
    list_sort(list_concat(g.items, [s.items[i] FOR i IN range(1, len(s.items) + 1) IF s.bins[i] = list_max(s.bins)])) AS items FROM s JOIN g ON g.shard = s.shard AND g.k = s.k + 1)),
 u AS (SELECT shard, done, list_max(bins) AS top, k = max(k) OVER (PARTITION BY shard) AS last, unnest(items).id AS doc_id, unnest(bins) AS bin FROM s)
 SELECT shard, doc_id, done + bin - 1 AS pack_id FROM u WHERE last OR bin < top"""


@query("pck03_streaming_packing", _stream_packs_sql("index // 128"))
def _(s, d):
    """Packs of 128 rows at a time in the order of the index, though files bring the rows out of order; a second run of the
    query, from its checkpoint, brings what was missing, and its timer flushes what is left."""
    base = scratch_dir(s, "packs")
    rows = docs(s, d).select((F.col("doc_id") % 2).alias("shard"), F.col("doc_id").alias("key"), F.col("n_chars").alias("length"))
    rows = running(rows, F.lit(1), [F.col("key")], "index", ["shard"])
    late = F.col("index") % 5 == 3
    rows.where(~late).repartition(4, F.xxhash64("key")).write.parquet(base + "/in")

    def start(files_: int, idle: int | None):  # noqa: ANN202
        src = streams.file_stream(s, base + "/in", "shard bigint, key bigint, length bigint, index bigint", "parquet", files_)
        return _started(streams.interval_packs(src, 8192, 128, idle), base)

    def run() -> DataFrame:
        first, last = rows.where(~late).count(), rows.where(late).count()
        with start(1, None) as query:
            streams.run_until(query, lambda n, _: n >= first)
        rows.where(late).write.mode("append").parquet(base + "/in")
        with start(1000, 500) as query:
            streams.run_until(query, lambda n, left: n >= last and not left)
        return s.read.parquet(base + "/out").select("shard", F.col("key").alias("doc_id"), "pack_id")

    return _with_rocksdb(s, run)


@query("str05_stateful_packing", _stream_packs_sql("doc_id % 3"))
def _(s, d):
    """Packing in three runs of a query, each going on from the checkpoint with the last bin of the one before; the third flushes."""
    base = scratch_dir(s, "resumed")
    rows = docs(s, d).select((F.col("doc_id") % 2).alias("shard"), F.col("doc_id").alias("key"), F.col("n_chars").alias("length"))

    def run() -> DataFrame:
        for k in range(3):
            part = rows.where(F.col("key") % 3 == k)
            part.write.mode("append").parquet(base + "/in")
            n = part.count()
            src = streams.file_stream(s, base + "/in", "shard bigint, key bigint, length bigint", "parquet", 1000)
            with _started(streams.stream_packs(src, 8192, 500 if k == 2 else None), base) as query:
                streams.run_until(query, lambda came, left, want=n, last=k == 2: came >= want and not (last and left))
        return s.read.parquet(base + "/out").select("shard", F.col("key").alias("doc_id"), "pack_id")

    return _with_rocksdb(s, run)


@query("str06_streaming_sessions", "SELECT user_id AS key, event_id AS pos, (sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM events")
def _(s, d):
    base = scratch_dir(s, "sessions")
    path = base + "/one"
    table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("start")).orderBy("pos").coalesce(1).write.parquet(path)

    def run() -> DataFrame:
        src = streams.file_stream(s, path, "key bigint, pos bigint, start boolean", "parquet", 1)
        streams.run_available(streams.stream_sessions(src), lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}"), base + "/check")
        return s.read.parquet(base + "/out").select("key", "pos", "session")

    return _with_rocksdb(s, run)


