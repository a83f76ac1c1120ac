"""Structured Streaming: file streams, stateful packing and sessions, running means, resumable sinks."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators.packing import best_fit


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, each micro-batch written once; a rerun goes on where the last one ended."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def append_jsonl(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of JSON lines, one folder for each micro-batch, so that a repeated batch replaces itself."""
    return lambda batch, k: batch.write.mode("overwrite").json(f"{path}/batch={k}")


def take_skip(df: DataFrame, order: str, skip: int, take: int, out: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps rows skip .. skip + take of the whole stream; the count so far is read from the sink."""
    def write(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.parquet(f"{out}/seen").where(F.col("batch") < k).agg(F.sum("n")).first()[0] or 0 if k else 0
        n = batch.count()
        spark.createDataFrame([(k, n)], "batch long, n long").write.mode("append").parquet(f"{out}/seen")
        low, high = max(0, skip - seen), max(0, min(n, skip + take - seen))
        batch.orderBy(order).limit(high).offset(low).write.mode("overwrite").parquet(f"{out}/rows/batch={k}")

    return write


def run_until(query: StreamingQuery, done: Callable[[int, int], bool], limit: float = 600.0) -> None:
    """Waits until done(rows read in, rows of state left), both of the query's progress so far; TimeoutError beyond `limit` seconds."""
    end, seen, rows = time.monotonic() + limit, -1, 0
    while time.monotonic() < end:
        if query.exception() is not None:
            raise query.exception()
        for p in query.recentProgress:
            if p.batchId > seen:
                seen, rows = p.batchId, rows + p.numInputRows
        last = query.lastProgress
        if last is not None and done(rows, sum(o.numRowsTotal for o in last.stateOperators)):
            return
        time.sleep(0.1)
    raise TimeoutError(f"after {limit} seconds {rows} rows were read")


def draw(seed: object, lane: object, n: int, size: int) -> int:
    """A number below size, the same on every run."""
    return int(hashlib.md5(f"{seed}|{lane}|{n}".encode()).hexdigest()[:8], 16) % size


class Lane(StatefulProcessor):
    """A lane of a stream that may never end: what is held when no row has come for `idle` milliseconds is flushed by a timer.

    idle None: no timer; what is held waits for a later run of the query."""

    def __init__(self, idle: int | None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, now: object) -> None:
        """Puts the timer off."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.idle is not None:
            self.handle.registerTimer(now.getCurrentProcessingTimeInMs() + self.idle)

    def close(self) -> None:
        pass


#: Rows of a lane that are handed on at once.
OUT_ROWS = 100_000


class ShuffleBuffer(Lane):
    """A buffer of fixed capacity in the state store, which outlives micro-batches: once it is full, each row that comes in takes
    the place of a random one, which goes out. The timer empties the buffer, in random order."""

    def __init__(self, capacity: int, seed: object, idle: int | None) -> None:
        super().__init__(idle)
        self.capacity, self.seed = capacity, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.slots = handle.getMapState("slots", "slot long", "key long, row string")
        self.counts = handle.getValueState("counts", "came long, gone long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        came, gone = self.counts.get() if self.counts.exists() else (0, 0)
        # The slots are read once and written once a micro-batch: a call to the state for each row costs far more than the row.
        held = {slot[0]: tuple(value) for slot, value in self.slots.iterator()} if came else {}
        changed, pdf = set(), pd.concat([x[["key", "row"]] for x in rows]).sort_values("key")
        for at in range(0, len(pdf), OUT_ROWS):
            first, out, part = gone, [], pdf.iloc[at : at + OUT_ROWS]
            for k, row in zip(part["key"].tolist(), part["row"].tolist(), strict=True):
                slot = came - gone  # slots fill in order
                if slot >= self.capacity:
                    slot = draw(self.seed, key[0], came, self.capacity)
                    out.append(held[slot])
                    gone += 1
                held[slot] = (k, row)
                changed.add(slot)
                came += 1
            if out:
                yield pd.DataFrame([(key[0], first + i, *x) for i, x in enumerate(out)], columns=["lane", "place", "key", "row"])
        for slot in changed:
            self.slots.updateValue((slot,), held[slot])
        self.counts.update((came, gone))
        self.wait(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.counts.exists():
            return
        _, gone = self.counts.get()
        left = sorted(((hashlib.md5(f"{self.seed}|{key[0]}|slot|{slot[0]}".encode()).hexdigest(), value) for slot, value in self.slots.iterator()), key=lambda x: x[0])
        self.slots.clear()
        self.counts.clear()
        yield pd.DataFrame([(key[0], gone + i, *value) for i, (_, value) in enumerate(left)], columns=["lane", "place", "key", "row"])


def buffer_shuffle(rows: DataFrame, capacity: int, seed: object = 42, idle: int | None = 1000) -> DataFrame:
    """rows (lane, key, row) to (lane, place, key, row): each lane in the order in which its buffer lets rows go. A flushed
    lane starts anew. Needs the RocksDB state store."""
    return rows.groupBy("lane").transformWithStateInPandas(ShuffleBuffer(capacity, seed, idle), "lane long, place long, key long, row string", "Append", "ProcessingTime")


class Packer(Lane):
    """Packs a shard's rows, each micro-batch with the last bin of the one before; the timer lets the last bin go."""

    def __init__(self, volume: int, idle: int | None) -> None:
        super().__init__(idle)
        self.volume = volume

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rest = handle.getListState("rest", "key long, length long")
        self.done = handle.getValueState("done", "n long")

    def packed(self, shard: int, items: list[tuple[int, int]], last: bool) -> list[tuple]:
        """Rows of the packs that are final; the last one is kept as the rest unless all are."""
        bins = best_fit(items, self.volume)
        keep = [] if last or not bins else bins.pop()
        n = self.done.get()[0] if self.done.exists() else 0
        self.done.update((n + len(bins),))
        if keep:
            self.rest.put(keep)
        else:
            self.rest.clear()
        return [(shard, n + b, i, k, size) for b, x in enumerate(bins) for i, (k, size) in enumerate(x)]

    def held(self) -> list[tuple[int, int]]:
        return [(r[0], r[1]) for r in self.rest.get()] if self.rest.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        items = self.held() + [(int(k), int(n)) for pdf in rows for k, n in zip(pdf["key"], pdf["length"], strict=True)]
        self.wait(timerValues)
        yield pd.DataFrame(self.packed(key[0], items, False), columns=["shard", "pack_id", "pos", "key", "length"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = self.packed(key[0], self.held(), True)
        self.done.clear()  # a later row starts a new run of packs
        yield pd.DataFrame(out, columns=["shard", "pack_id", "pos", "key", "length"])


class IntervalPacker(Packer):
    """Packs a shard's rows in the order of their index, `interval` rows at a time, whatever the micro-batches: rows that come early
    wait in the state for those before them. The timer packs all that is left, over gaps in the index."""

    def __init__(self, volume: int, interval: int, idle: int | None) -> None:
        super().__init__(volume, idle)
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.early = handle.getMapState("early", "index long", "key long, length long")
        self.next = handle.getValueState("next", "index long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for i, k, n in zip(pdf["index"].tolist(), pdf["key"].tolist(), pdf["length"].tolist(), strict=True):
                self.early.updateValue((i,), (k, n))
        at, out = self.next.get()[0] if self.next.exists() else 0, []
        # Interval by interval, as soon as all its rows are there.
        while all(self.early.containsKey((at + i,)) for i in range(self.interval)):
            items = [tuple(self.early.getValue((at + i,))) for i in range(self.interval)]
            for i in range(self.interval):
                self.early.removeKey((at + i,))
            out += self.packed(key[0], self.held() + items, False)
            at += self.interval
        self.next.update((at,))
        self.wait(timerValues)
        yield pd.DataFrame(out, columns=["shard", "pack_id", "pos", "key", "length"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        left, out = [tuple(v) for _, v in sorted((tuple(k), tuple(v)) for k, v in self.early.iterator())], []
        while len(left) >= self.interval:
            out += self.packed(key[0], self.held() + left[: self.interval], False)
            left = left[self.interval :]
        out += self.packed(key[0], self.held() + left, True)
        for state in (self.early, self.next, self.done):
            state.clear()
        yield pd.DataFrame(out, columns=["shard", "pack_id", "pos", "key", "length"])


_PACKS = "shard long, pack_id long, pos long, key long, length long"


def stream_packs(rows: DataFrame, volume: int, idle: int | None = 1000) -> DataFrame:
    """rows (shard, key, length) to packs, micro-batch by micro-batch; needs the RocksDB state store."""
    return rows.groupBy("shard").transformWithStateInPandas(Packer(volume, idle), _PACKS, "Append", "ProcessingTime")


def interval_packs(rows: DataFrame, volume: int, interval: int = 128, idle: int | None = 1000) -> DataFrame:
    """rows (shard, index, key, length), index from 0 in each shard, to packs; needs the RocksDB state store."""
    return rows.groupBy("shard").transformWithStateInPandas(IntervalPacker(volume, interval, idle), _PACKS, "Append", "ProcessingTime")


class Sessions(StatefulProcessor):
    """Numbers sessions of a key: a marked row starts a new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("pos")
        n = self.at.get()[0] if self.at.exists() else 0
        session = n + pdf["start"].astype("int64").cumsum()
        self.at.update((int(session.iloc[-1]),))
        yield pd.DataFrame({"key": key[0], "pos": pdf["pos"], "session": session})

    def close(self) -> None:
        pass


def stream_sessions(rows: DataFrame) -> DataFrame:
    """rows (key, pos, start) to (key, pos, session)."""
    return rows.groupBy("key").transformWithStateInPandas(Sessions(), "key long, pos long, session long", "Append", "None")


def running_means(rows: DataFrame, key: str, mean: str, n: str) -> DataFrame:
    """Count-weighted means on a stream (complete or update mode)."""
    return rows.groupBy(key).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("mean"), F.sum(n).alias("count"))


def windowed_stats(log: DataFrame, ts: str, request: str, order: str, prompt: str, generated: str, interval: str, late: str = "1 minute") -> DataFrame:
    """Tumbling windows over the time of completion: totals of the last usage of each request."""
    log = log.withWatermark(ts, late) if log.isStreaming else log
    per = log.groupBy(F.window(ts, interval).alias("w"), request).agg(F.max_by(prompt, order).alias("p"), F.max_by(generated, order).alias("g"))
    out = per.groupBy("w") if not log.isStreaming else per.groupBy(F.window(F.window_time("w"), interval).alias("w"))
    return out.agg(F.sum("p").alias("num_prompt_tokens"), F.sum("g").alias("num_generated_tokens"), F.count("*").alias("num_samples")).select(F.col("w.start").alias("start"), "num_prompt_tokens", "num_generated_tokens", "num_samples")
