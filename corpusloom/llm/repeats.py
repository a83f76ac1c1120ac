"""Repeated byte strings, found by suffix order and common prefixes in shards (external induced sorting).

Every string of LENGTH bytes (a window) that also starts earlier, by doc_id and position, is repeated; the bytes of
repeated windows go. Windows never span documents and are judged on the input.

Sharding: each window has an anchor, the least of the hashes of its GRAM-byte strings (the first of equal ones). Equal windows have
equal anchors at the same place, so they meet in the shard of the anchor's hash. A run of windows that share an anchor is a
body (about 170 bytes at most). A first pass counts anchors; those that occur once, most of them, hold no repeated window. Equal bodies are
combined before anything else, first within each batch that is read, then by one sorted shuffle: all but the earliest of them consist of
repeated windows. What is left to compare, an anchor's different bodies that share a core (most bytes of a window; counted like anchors), goes to the shards
in order of doc_id and position. A shard sorts the
suffixes of its bodies by induction (llm/induced.py) in external memory, and reads equal windows off the common prefixes: all but the first in
the text of the shard are repeated.

Scale: what is worth sending is looked up in bitmaps of BITS bits, whatever the corpus; they only thin rows out: a body that is sent
without need changes no result, so where they fill up more rows are sent. Of a body that a third of all documents hold, each batch of rows
sends one (rarer ones aren't combined there: copies of few rows seldom meet in a batch of a large corpus). An anchor with more than HOT_BODIES different bodies is no shard's own: its bodies are dealt by windows, and equal windows are
combined by partial aggregation. A shard holds its bodies' numbers in memory, their bytes on disk.

Cases: null and empty texts and texts under LENGTH bytes keep all their bytes; a null doc_id comes after all others; of
rows that share a doc_id, the order goes by a hash of the text, and rows that repeat both are one document and get the same
result; empty tables give an empty result; other columns are ignored. Long texts are worked on in overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.collocations import mix, powers
from corpusloom.llm.common import broadcast_if_small, materialise
from corpusloom.llm.induced import Growing, store, suffix_order
from corpusloom.llm.textbytes import PIECE_BYTES, pieces
from corpusloom.session import table

LENGTH, GRAM = 100, 32
#: log2 of the bitmap's bits (16 MB) and of its slices.
BITS, SLICES = 27, 8
HOT_BODIES = 10_000
#: Leads that share a core; a body that occurs so often in a batch of rows is sent once.
CORE_STEP, COMBINED = 16, 8
#: Bytes of a shard, about; a shard that is larger than memory is sorted on disk, a small one mostly in memory.
SHARD_BYTES = 3 << 20
_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)


def blocks(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, offset in it, bytes, offsets): pieces of whole texts, or overlapping parts of a long one; each window is in one."""
    for first, data, at in pieces(column):
        step = 4 * PIECE_BYTES
        if len(data) <= step or len(at) > 2:
            yield first, 0, data, at
        else:
            for a in range(0, len(data) - length + 1, step):
                part = data[a : a + step + length - 1]
                yield first, a, part, np.array([0, len(part)])


class Slices:
    """Hashes of slices of bytes, as differences of one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[: len(data)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def bodies_of(data: np.ndarray, at: np.ndarray, length: int, gram: int, slices: Slices | None = None) -> tuple[np.ndarray, ...]:
    """(text, key, digest, start, windows, lead) of each run of windows that share an anchor; starts are places in data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * 6
    n, width = len(data), length - gram + 1
    slices = slices or Slices(data)
    key = mix((slices.total[gram:] - slices.total[:-gram]) * slices.down[: n - gram + 1])
    value = key & np.uint64(0xFFFFFFFF00000000) | np.arange(n - gram + 1, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < width:
        value = np.minimum(value[: span - width], value[width - span :])
    anchor = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(anchor)) - 1
    room = at[text[start] + 1] - length  # the last window of the text
    own = start <= room
    start, last = start[own], np.minimum(last[own], room[own])
    lead, windows = anchor[start] - start, last - start + 1
    digest = mix(slices(start, last + length) + windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + lead.astype(np.uint64))
    # Least hashes are small, so they are mixed again for bitmaps and partitions.
    return text[start], mix(key[anchor[start]] + np.uint64(1)).view(np.int64), digest.view(np.int64), start, windows, lead


def cores_of(slices: Slices, key: np.ndarray, start: np.ndarray, windows: np.ndarray, lead: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(least lead, most lead, which bodies, hash): the bytes that all windows with these leads have in common, of the bodies that have
    such windows. Equal windows have the same lead, and so an equal core."""
    step = max(1, min(CORE_STEP, length // 4))
    for low in range(0, length - gram + 1, step):
        high = low + step - 1
        own = np.flatnonzero((lead >= low) & (lead - windows < high))
        anchor = start[own] + lead[own]
        yield low, high, own, mix(slices(anchor - low, anchor - high + length) + key[own].view(np.uint64) * np.uint64(3) + np.uint64(low * 7919 + 1)).view(np.int64)


def bitmap(tags: DataFrame) -> np.ndarray:
    """A bit for the leading BITS bits of each hash (column tag), as bytes of fixed size; tasks make slices of it."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, made = 1 << (BITS - SLICES), {}
        for batch in batches:
            bit = batch.column(0).to_numpy()
            for k in np.unique(bit >> (BITS - SLICES)).tolist():
                made.setdefault(k, np.zeros(size, bool))[bit[bit >> (BITS - SLICES) == k] & (size - 1)] = True
        for k, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    bit = F.shiftrightunsigned("tag", 64 - BITS).alias("bit")
    rows = tags.select(bit).repartition(F.shiftright("bit", BITS - SLICES)).mapInArrow(fill, "slice long, bits binary").collect()
    out = np.zeros((1 << SLICES, 1 << (BITS - SLICES - 3)), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _hit(bits: np.ndarray, tag: np.ndarray) -> np.ndarray:
    bit = (tag.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def _spans(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each text as runs."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    reach = np.maximum.accumulate((text.astype(np.int64) << 40) + end)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:].astype(np.int64) << 40) + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first], reach[last] & ((1 << 40) - 1)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key): the anchors' hashes of all bodies of rows (doc_id, doc, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in blocks(batch.column(0), length):
                yield pa.RecordBatch.from_arrays([pa.array(bodies_of(data, at, length, gram)[1])], ["key"])

    return docs.select("text").mapInArrow(emit, "key long")


def occurrences(docs: DataFrame, length: int, gram: int, bits: np.ndarray) -> DataFrame:
    """Bodies whose key has a bit. One that occurs COMBINED times or more in a batch comes once, for its earliest place there. The others
    of it are repeated: their windows are put out as runs of bytes (lead -1, windows: the number of bytes), with the document's hash as key."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    names = ["key", "digest", "doc_id", "doc", "start", "windows", "lead"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc = batch.column("doc_id").cast(id_type), batch.column("doc").to_numpy()
            found = []
            for first, offset, data, at in blocks(batch.column("text"), length):
                text, key, digest, start, windows, lead = bodies_of(data, at, length, gram)
                own = _hit(held.value, key)
                text, key, digest, start, windows, lead = (x[own] for x in (text, key, digest, start, windows, lead))
                found.append(np.stack([first + text, key, digest, start - at[text] + offset, windows, lead]))
            if not found:
                continue
            text, key, digest, start, windows, lead = np.concatenate(found, axis=1)
            if not len(text):
                continue
            rank = np.empty(len(doc), np.int64)
            rank[_id_order(ids, doc)] = np.arange(len(doc))
            place = start + lead
            order = np.lexsort((place, rank[text], digest, key))
            text, key, digest, start, windows, lead, place = (x[order] for x in (text, key, digest, start, windows, lead, place))
            new = np.ones(len(text), bool)
            new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))
            often = np.diff(np.append(np.flatnonzero(new), len(text))) >= COMBINED
            often = np.repeat(often, np.diff(np.append(np.flatnonzero(new), len(text))))
            later = np.flatnonzero(often & ((doc[text] != doc[text[first]]) | (place != place[first])))
            new = np.flatnonzero(new | ~often)
            columns = [key[new], digest[new], None, doc[text[new]], start[new], windows[new], lead[new]]
            yield _batch(columns, ids.take(pa.array(text[new])), names)
            if not len(later):
                continue
            row, a, b = _spans(text[later], start[later], start[later] + windows[later] - 1 + length)
            yield _batch([doc[row], np.zeros(len(row), np.int64), None, doc[row], a, b - a, np.full(len(row), -1)], ids.take(pa.array(row)), names)

    return docs.mapInArrow(emit, f"key long, digest long, doc_id {kind.simpleString()}, doc long, start int, windows int, lead int")


def _id_order(ids: pa.Array, doc: np.ndarray) -> np.ndarray:
    """Rows by doc_id, null last, then by the documents' hashes."""
    table_ = pa.table({"id": ids, "doc": doc})
    return pc.sort_indices(table_, [("id", "ascending"), ("doc", "ascending")], null_placement="at_end").to_numpy()


def _batch(columns: list, ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids if x is None else pa.array(x.astype(np.int32) if n in ("start", "windows", "lead") else x) for x, n in zip(columns, names, strict=True)], names)


def settled(rows: DataFrame, length: int) -> DataFrame:
    """(key, digest, doc_id, doc, start, end) of occurrences: the earliest place of each body, with its key, and all
    repeated runs of bytes, with a null key. One pass over a sorted shuffle that remembers one body."""
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None  # key, digest, doc and place of the earliest of the open body
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").cast(id_type)
            key, digest, doc, start, windows, lead = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "digest", "doc", "start", "windows", "lead"))
            run = lead < 0
            place = start + lead
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]) | run[1:] | run[:-1]
            goes_on = known is not None and not run[0] and known[:2] == (key[0], digest[0])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            first_doc, first_place = doc[first], place[first]
            if goes_on:
                first_doc[first == 0], first_place[first == 0] = known[2:]
                new[0] = False
            known = None if run[-1] else (key[-1], digest[-1], first_doc[-1], first_place[-1])
            repeated = run | (~new & ((doc != first_doc) | (place != first_place)))
            keep = np.flatnonzero(new | repeated)
            some = repeated[keep]
            end = np.where(run, start + windows, start + windows - 1 + length)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep], mask=some), pa.array(digest[keep], mask=some), ids.take(pa.array(keep)), pa.array(doc[keep]), pa.array(start[keep]), pa.array(end[keep])], ["key", "digest", "doc_id", "doc", "start", "end"])

    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("doc"), F.col("start") + F.col("lead")]
    return rows.repartition("key", "digest").sortWithinPartitions("key", "digest", *order).mapInArrow(stream, f"key long, digest long, doc_id {kind.simpleString()}, doc long, start long, end long")


def bodies_with_bytes(docs: DataFrame, length: int, gram: int, keys: np.ndarray, tags: np.ndarray, cores: np.ndarray | None) -> DataFrame:
    """(key, doc_id, doc, start, lead, body) of bodies with a bit for their key, one for their place and one for a core, without the
    windows before and behind those with such cores. Without `cores`: (core), the cores of bodies with the first two bits."""
    held = docs.sparkSession.sparkContext.broadcast((keys, tags, cores))
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags, cores = held.value
        for batch in batches:
            ids, doc = batch.column("doc_id").cast(id_type), batch.column("doc").to_numpy()
            for first, offset, data, at in blocks(batch.column("text"), length):
                if len(data) < length:
                    continue
                slices = Slices(data)
                text, key, digest, start, windows, lead = bodies_of(data, at, length, gram, slices)
                own = _hit(keys, key)
                own = own[_hit(tags, key[own] ^ digest[own] ^ doc[first + text[own]] ^ (start - at[text] + offset)[own] << 37)]
                if not len(own):
                    continue
                text, key, start, windows, lead = (x[own] for x in (text, key, start, windows, lead))
                if cores is None:
                    for *_, core in cores_of(slices, key, start, windows, lead, length, gram):
                        yield pa.RecordBatch.from_arrays([pa.array(core)], ["core"])
                    continue
                least, most = np.full(len(own), length), np.full(len(own), -1)
                for low, high, some, core in cores_of(slices, key, start, windows, lead, length, gram):
                    some = some[_hit(cores, core)]
                    least[some], most[some] = np.minimum(least[some], low), np.maximum(most[some], high)
                some = np.flatnonzero(most >= 0)
                text, key, start, windows, lead, least, most = (x[some] for x in (text, key, start, windows, lead, least, most))
                anchor, first_lead, last_lead = start + lead, np.minimum(lead, most), np.maximum(lead - windows + 1, least)
                start, lead, sizes = anchor - first_lead, first_lead, first_lead - last_lead + length
                if not len(text):
                    continue
                ends = np.concatenate([[0], np.cumsum(sizes)])
                where = np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1])
                body = pa.BinaryArray.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[where])])
                yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(first + text)), pa.array(doc[first + text]), pa.array((start - at[text] + offset).astype(np.int32)), pa.array(lead.astype(np.int32)), body], ["key", "doc_id", "doc", "start", "lead", "body"])

    return docs.mapInArrow(emit, "core long" if cores is None else f"key long, doc_id {kind.simpleString()}, doc long, start int, lead int, body binary")


def sorted_repeats(bodies: DataFrame, length: int) -> DataFrame:
    """(doc_id, doc, start, end) of the repeated windows among bodies that are in order within each partition."""
    kind = bodies.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, begins, doc, local = Growing(np.uint16), Growing(np.int64), Growing(np.int64), Growing(np.int64)
        symbols.append(np.zeros(1))
        ids, before = [], (None, None, None)
        for batch in batches:
            # Rows of a document that is there several times follow one another.
            rows = np.stack([batch.column("doc").to_numpy(), batch.column("start").to_numpy(), pc.binary_length(batch.column("body")).to_numpy()])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            if batch.num_rows:
                new[0], before = tuple(rows[:, 0].tolist()) != before, tuple(rows[:, -1].tolist())
            batch = batch.filter(pa.array(new))
            for _, data, at in pieces(batch.column("body")):
                n = len(at) - 1
                out = np.zeros(len(data) + n, np.uint16)
                out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data.astype(np.uint16) + 1
                begins.append(symbols.size + at[:-1] + np.arange(n))
                symbols.append(out)
            ids.append(batch.column("doc_id").cast(id_type))
            doc.append(batch.column("doc").to_numpy())
            local.append(batch.column("start").to_numpy())
        if not doc.size:
            return
        text, begins, doc, local = (x.array() for x in (symbols, begins, doc, local))
        ids = pa.chunked_array(ids)
        gone = store(len(text), np.bool_)
        least = -1  # the first place of the open class of equal windows

        def classes(place: np.ndarray, common: np.ndarray) -> None:
            nonlocal least
            new = common < length
            at = np.flatnonzero(new)
            if not len(at) or at[0]:
                at = np.concatenate([[0], at])
            first = np.minimum.reduceat(place, at)
            if not new[0] and least >= 0:  # goes on with the open class
                if first[0] < least:
                    gone[least] = True
                first[0] = min(int(first[0]), least)
            sizes = np.diff(np.append(at, len(place)))
            gone[place[place > np.repeat(first, sizes)]] = True
            least = int(first[-1])

        suffix_order(text, 256, classes)
        for a in range(0, len(gone), 1 << 22):
            flagged = np.flatnonzero(gone[a : a + (1 << 22)]) + a
            if not len(flagged):
                continue
            cut = np.flatnonzero(np.diff(flagged) > 1) + 1
            low, high = flagged[np.concatenate([[0], cut])], flagged[np.append(cut, len(flagged)) - 1]
            body = np.searchsorted(begins, low, "right") - 1
            start = local[body] + low - begins[body]
            for b in range(0, len(body), 1 << 16):
                own = slice(b, b + (1 << 16))
                some = ids.take(pa.array(body[own])).combine_chunks()
                end = start[own] + (high - low)[own] + length
                yield pa.RecordBatch.from_arrays([some, pa.array(doc[body[own]]), pa.array(start[own]), pa.array(end)], ["doc_id", "doc", "start", "end"])

    return bodies.mapInArrow(shard, f"doc_id {kind.simpleString()}, doc long, start long, end long")


def _order(place: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("doc").alias("doc"), place.alias("place"))


def window_repeats(bodies: DataFrame, length: int) -> DataFrame:
    """What sorted_repeats gives, window by window, for anchors with very many different bodies."""
    at = F.explode(F.expr(f"sequence(0, length(body) - {length})"))
    windows = bodies.select("doc_id", "doc", "start", "body", at.alias("at"))
    windows = windows.select(F.unhex(F.md5(F.expr(f"substring(body, at + 1, {length})"))).alias("window"), "doc_id", "doc", (F.col("start") + F.col("at")).cast("long").alias("place"))
    windows = materialise(windows, "windows")
    firsts = windows.groupBy("window").agg(F.min(_order(F.col("place"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    later = windows.join(firsts, "window").where(F.col("first") != _order(F.col("place")))
    return later.select("doc_id", "doc", F.col("place").alias("start"), (F.col("place") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bodies: int = HOT_BODIES) -> DataFrame:
    """(doc_id, doc, start, end) of repeated windows, in bytes, for rows (doc_id, doc, text); spans overlap."""
    many = anchors(docs, length, gram).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = settled(occurrences(docs, length, gram, bitmap(many.select(F.col("key").alias("tag")))), length)
    found = materialise(found, "settled")
    firsts = found.where("key IS NOT NULL")
    kinds = materialise(firsts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    keys = bitmap(kinds.select(F.col("key").alias("tag")))
    tags = bitmap(firsts.select(F.expr("key ^ digest ^ doc ^ shiftleft(start, 37)").alias("tag")))
    # Of an anchor's bodies only those are compared that share a core with another one.
    cores = bodies_with_bytes(docs, length, gram, keys, tags, None).groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    texts = bodies_with_bytes(docs, length, gram, keys, tags, bitmap(cores.select(F.col("core").alias("tag"))))
    hot = kinds.where(F.col("kinds") > hot_bodies).select("key")
    n_hot, n_bodies = kinds.agg(F.count_if(F.col("kinds") > hot_bodies), F.sum("kinds")).first()
    shards = max(1, -(-(n_bodies or 0) * 2 * length // SHARD_BYTES))
    if n_hot:
        hot = broadcast_if_small(hot, n_hot)
        windows = window_repeats(texts.join(hot, "key"), length)
        texts = texts.join(hot, "key", "left_anti")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("doc"), F.col("start") + F.col("lead")]
    ordered = texts.repartition(shards, "key").sortWithinPartitions(*order).select("doc_id", "doc", "start", "body")
    spans = found.where("key IS NULL").select("doc_id", "doc", "start", "end").union(sorted_repeats(ordered, length))
    return spans.union(windows) if n_hot else spans


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bodies: int = HOT_BODIES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: what is removed, as maximal runs of bytes, and the bytes that stay."""
    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(named, length, gram, hot_bodies)
    grouped = spans.groupBy("doc_id", "doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "spans")
    joined = named.join(grouped, (F.col("doc") == F.col("_doc")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_runs, kept = [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, runs, rest, at = text.as_py(), [], [], 0
                for s in sorted((x["start"], x["end"]) for x in found.as_py() or ()):
                    if runs and s[0] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s[1])
                    else:
                        runs.append({"start": s[0], "end": s[1]})
                for r in runs:
                    rest.append(data[at : r["start"]])
                    at = r["end"]
                rest.append(data[at:])
                sizes.append(len(data))
                all_runs.append(runs)
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_type), pa.array(sizes, pa.int64()), pa.array(all_runs, span_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind.simpleString()}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 100-byte strings: sizes, runs removed and the digest of the rest."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
