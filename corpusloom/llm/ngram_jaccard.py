"""Similarity join of documents by the Jaccard index of their word n-gram sets, exact.

The product of the document by n-gram incidence matrix with its transpose holds the overlap of every
pair. It is computed in blocks, and only in blocks that can hold a pair above the threshold.

1. Equal sets are collapsed to one node by a 128-bit digest (copies may be any share of the rows).
2. Blocks of rows. With a threshold t, sets of sizes a and b differ in at most (1-t)/(1+t) (a+b) n-grams.
   So if the n-gram space is dealt at random into more parts than that (the number is derived from the
   size class), two linked sets agree wholly on some part. A node emits a key for each of its parts,
   a hash of all its n-grams there; keys that are shared make candidate blocks. A passage that many
   documents hold does not fill a part by itself, so frequent n-grams are no hot keys and no statistics
   of n-grams are needed. The least node of a key, found in each task before the shuffle, stands for it; a window over the keys then finds the least
   of all tasks, which sorts one row a key and part of the documents (PART keys): a key that every part holds has as many rows as there are parts. Parts that are empty in a set carry no key unless a set has so many of them
   that they alone could be the agreement; then a prefix of them does, which keeps the join complete.
3. Refinement. Nodes joined by keys form blocks. In blocks of more than CHUNK nodes the nodes of each key's
   head are compared by sketches (n-grams counted in bins, which bound the overlap from above), and the
   block is cut to what can be linked.
4. Product. A block of more than CHUNK nodes, or CHUNK_BYTES of sets, is cut into chunks, and
   each pair of chunks is a task of its own with bounded size. Overlap counts are accumulated over the
   n-grams that at least two nodes hold, pair by pair where few do and by dense panels where many do; pairs
   whose sizes rule them out, and pairs below the overlap that their sizes demand, are discarded. Of the
   links, a spanning forest leaves.
5. Components over all links.

A block with m nodes costs (m / CHUNK)^2 tasks, and a head with m nodes (m / SKETCHES)^2 of sketches; that
is the price of exactness for near copies that all differ. Hashes of n-grams have 64 bits.

Cases: null and empty texts have an empty set and link with nothing; a null doc_id gets its size and no
component and takes no part; rows that repeat a doc_id count as one document, whose set is that of its text
with the smallest hash (each row has the size of its own set); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, components, materialise
from corpusloom.session import table

#: Nodes of a chunk, columns of a panel, nodes of a task made of small blocks, word hashes that a worker keeps.
CHUNK, PANEL, UNIT, KEPT = 400, 2048, 2000, 250_000
#: Bytes of the sets of a chunk, and of a task made of small blocks.
CHUNK_BYTES, UNIT_BYTES = 16 << 20, 32 << 20
#: Keys that a worker combines at once.
PART = 1 << 20
#: Columns of at most so many rows are added pair by pair.
SPARSE = 8
#: Bins of a sketch, and nodes of a chunk of sketches.
BINS, SKETCHES = 256, 1000
#: Size classes grow by this factor, or by 1 / threshold if that is more.
RATIO = 1.4
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of hashed word n-grams: ASCII letters lower-cased, words parted by ASCII white space."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def codes(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8", "surrogatepass").lower().split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, words), _U, len(words))
        except KeyError:
            if len(known) > KEPT:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), _U, len(words))

    def set(self, text: str | None) -> np.ndarray:
        c = self.codes(text or "")
        n = min(self.width, len(c))
        if not n:
            return np.zeros(0, _U)
        h = np.full(len(c) - n + 1, n, _U)
        for j in range(n):
            h = _mix(h + c[j : len(c) - n + 1 + j])
        return np.unique(h)


@lru_cache(maxsize=4096)
def class_start(k: int, num: int, den: int) -> int:
    b = 1
    for _ in range(k):
        b = max(b + 1, math.ceil(b * max(RATIO, den / num)))
    return b


@lru_cache(maxsize=4096)
def level(k: int, num: int, den: int) -> tuple[int, int]:
    """(parts, tolerated empty parts) for pairs whose larger set is in class k."""
    high = class_start(k + 1, num, den) - 1
    differ = 2 * high * (den - num) // (den + num)
    if not differ:
        return 1, 0
    least = class_start(k, num, den) * num / den
    spare = max(1, math.ceil(1.6 * differ * math.exp(-least / (differ + 1))))
    return differ + 1 + spare, spare


def levels_of(n: int, num: int, den: int) -> list[int]:
    k = 0
    while class_start(k + 1, num, den) <= n:
        k += 1
    return [k, k + 1] if n * den >= class_start(k + 1, num, den) * num else [k]


def block_keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of a set: two sets at or above the threshold share one."""
    out = []
    for k in levels_of(len(h), num, den) if len(h) else []:
        parts, spare = level(k, num, den)
        own = _mix(h ^ _U(0xA0761D6478BD642F))
        part = ((own >> _U(32)) * _U(parts)) >> _U(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        which = part[first]
        salt = _U(k * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF)
        out.append(_mix(np.add.reduceat(own[order], first) ^ _mix(which * _U(2) + salt)))
        if parts - len(which) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=_U), which)[: parts - len(which) - spare]
            out.append(_mix(empty * _U(2) + salt + _U(1)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, n, d1, d2): hash of the text, and size and digest of the set, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for batch in batches:
            sets = [s.set(t) for t in batch.column("text").to_pylist()]
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64) for h in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([len(h) for h in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["doc_id", "h", "n", "d1", "d2"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, d1 long, d2 long")


def combined(keys: list[np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) rows of some documents, with each key once: for its least node. That its other nodes share a key with
    the least one is told by a key of the two alone, so a key of very many nodes has one row a part of the documents."""
    order = np.argsort(nodes, kind="stable")
    node = np.repeat(nodes[order], [len(keys[i]) for i in order])
    key = np.concatenate([keys[i] for i in order])
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    head = np.repeat(node[first], np.diff(np.concatenate([first, [len(key)]])))
    tied = np.unique(np.stack([node, head], 1)[node != head], axis=0)
    own = _mix(_mix(tied[:, 0].astype(_U)) + tied[:, 1].astype(_U))
    return np.concatenate([key[first], own, own]).view(np.int64), np.concatenate([node[first], tied[:, 0], tied[:, 1]])


def postings(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, node) rows of all documents, combined where they are read: nodes that share a key share it with one node in
    the same part, and those nodes of two parts share it with each other."""
    part = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        keys, nodes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, node = combined(keys, np.array(nodes, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

        for batch in batches:
            for node, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(k := block_keys(s.set(text), num, den)):
                    keys.append(k)
                    nodes.append(node)
                    held += len(k)
                if held >= part:
                    yield flush()
                    keys, nodes, held = [], [], 0
        if keys:
            yield flush()

    return docs.mapInArrow(run, "key long, node long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of sets: the sparse incidence matrix times its transpose.

    A column (an n-gram) adds one to each pair of its rows. Columns of few rows are added pair by pair, all columns of
    one number of rows at a time; those of more rows panel by panel as dense products.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    held = np.concatenate(sets)
    order = np.argsort(held, kind="stable")
    row, held = row[order], held[order]
    start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    many = np.diff(np.concatenate([start, [len(held)]]))
    total = np.zeros(n * n, np.int64)
    for k in range(2, min(SPARSE, n) + 1):
        at = start[many == k]
        for i in range(k):
            for j in range(i + 1, k):
                # Rows of a column ascend, so this fills the upper half.
                np.add.at(total, row[at + i] * n + row[at + j], 1)
    total = total.reshape(n, n)
    total += total.T
    total[np.diag_indices(n)] = size
    dense = many > SPARSE
    if dense.any():
        which = np.repeat(dense, many)
        row, column = row[which], np.repeat(np.arange(int(dense.sum())), many[dense])
        product = np.zeros((n, n), np.float32)  # counts below 2^24 are exact
        for p in range(0, int(dense.sum()), PANEL):
            a, b = np.searchsorted(column, [p, p + PANEL])
            panel = np.zeros((n, min(PANEL, int(dense.sum()) - p)), np.float32)
            panel[row[a:b], column[a:b] - p] = 1
            product += panel @ panel.T
        product[np.diag_indices(n)] = 0
        total += product.astype(np.int64)
    return total


def links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs of sets are at or above the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
    both = overlaps(sets)
    return (den * small >= num * large) & (den * both >= num * (small + large - both)) & (both > 0)


def sketch(h: np.ndarray) -> bytes:
    """How many n-grams fall in each of BINS bins, at most 255."""
    return np.minimum(np.bincount((h >> _U(20)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def near_sketches(sketches: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs can be linked by their sketches: bins bound the overlap from above, so no link is lost."""
    meet = np.zeros((len(size), len(size)), np.float32)
    for t in range(1, int(sketches.max(initial=0)) + 1):
        a = (sketches >= t).astype(np.float32)
        a = a[:, a.any(0)]
        meet += a @ a.T
    total = np.add.outer(size, size)
    clipped = (sketches == 255).any(1)  # their bins bound nothing
    fits = (den + num) * (total - 2 * meet) <= (den - num) * total
    small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
    return (fits | clipped[:, None] | clipped[None, :]) & (den * small >= num * large)


def spread(on: np.ndarray) -> np.ndarray:
    """The first node that each node reaches by links."""
    np.fill_diagonal(on, True)
    label = np.arange(len(on))
    while True:
        new = np.where(on, label[None, :], len(on)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(nodes: np.ndarray, on: np.ndarray, chunk: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span what the links connect. Of two chunks, each has a task of its own that spans it, so only the first
    node of each set that is connected within its chunk is tied to the others: few edges, however many nodes are linked."""
    label = spread(on)
    same = chunk[:, None] == chunk[None, :]
    tied = np.arange(len(nodes)) if same.all() else np.flatnonzero(spread(on & same) == np.arange(len(nodes)))
    return [(int(nodes[i]), int(nodes[label[i]])) for i in tied if label[i] != i]


def verified_links(docs: DataFrame, blocks: DataFrame, sizes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span the components within candidate blocks (node, component); sizes (doc_id, n) of all sets.

    A block is cut into chunks by its nodes and by the bytes of its sets, and small blocks share tasks up to so many bytes:
    a pair of chunks, or a unit of small blocks, is a task of bounded memory, but for one set that is larger by itself."""
    sized = materialise(blocks.join(sizes.select(F.col("doc_id").alias("node"), "n"), "node"), "sized-blocks")
    n_nodes, n_bytes = sized.agg(F.count("*"), 8 * F.sum("n")).first()
    units = max(1, math.ceil(n_nodes / UNIT), math.ceil((n_bytes or 0) / UNIT_BYTES))
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(8 * F.sum("n") / CHUNK_BYTES)).cast("int").alias("chunks")
    cut = materialise(blocks.join(sized.groupBy("component").agg(chunks), "component").select(F.col("node").alias("doc_id"), "component", "chunks"), "blocks")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["unit", "i", "j", "component", "node", "chunk", "ngrams"]
        for batch in batches:
            rows, held = [], 0
            for node, text, component, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "component", "chunks")), strict=True):
                data = s.set(text).tobytes()
                mixed = xxhash.xxh3_64_intdigest(component.to_bytes(8, "little", signed=True))
                if chunks == 1:
                    rows.append((mixed % units, -1, -1, component, node, 0, data))
                    held += len(data)
                else:
                    own = xxhash.xxh3_64_intdigest(node.to_bytes(8, "little", signed=True)) % chunks
                    for j in range(chunks):
                        rows.append((component, min(own, j), max(own, j), component, node, own, data))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def product(rows: pa.Table) -> pa.Table:
        component, node, chunk = (rows.column(c).to_numpy() for c in ("component", "node", "chunk"))
        data = rows.column("ngrams")
        out: list[tuple[int, int]] = []
        order = np.lexsort((node, component))
        for part in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            part = part[np.concatenate([[True], np.diff(node[part]) != 0])]  # rows that repeat a document
            if len(part) > 1:
                out += forest(node[part], links([np.frombuffer(data[int(k)].as_py(), _U) for k in part], num, den), chunk[part])
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    texts = docs.join(broadcast_if_small(cut, n_nodes), "doc_id").select("doc_id", "text", "component", "chunks")
    spread = texts.mapInArrow(expand, "unit long, i int, j int, component long, node long, chunk int, ngrams binary")
    return spread.groupBy("unit", "i", "j").applyInArrow(product, "a long, b long")


def refined(docs: DataFrame, pairs: DataFrame, large: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join nodes of large blocks (node, component) whose sketches allow a link.

    Nodes that share a key share its head, or their heads share one (pairs holds what each part of the documents
    combined), so every link lies within the group of a head or of a head's head: its nodes are compared by sketches,
    chunk against chunk. A passage that ties very many documents into one block
    by a few keys falls apart here at some hundred bytes a node and head.
    """
    n_large = large.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for batch in batches:
            sets = [s.set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([sketch(h) for h in sets], pa.binary())], ["node", "n", "sketch"])

    texts = docs.join(broadcast_if_small(large.select(F.col("node").alias("doc_id")), n_large), "doc_id").select("doc_id", "text")
    sketches = materialise(texts.mapInArrow(run, "node long, n long, sketch binary").dropDuplicates(["node"]), "sketches")
    own = pairs.join(broadcast_if_small(large.select("node"), n_large), "node", "left_semi")
    own = own.union(own.select("head", "head")).distinct().join(broadcast_if_small(large, n_large), "node")
    own = materialise(own, "head-groups")
    further = own.join(own.select(F.col("node").alias("head"), F.col("head").alias("further")), "head").select("node", F.col("further").alias("head"), "component")
    own = materialise(own.select("node", "head", "component").union(further).distinct(), "head-groups")
    # Where the heads of a block share so many nodes that all its pairs are fewer than those of its heads, it is one group.
    pairs_of = own.groupBy("component", "head").agg(F.count("*").alias("m")).groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("by_heads"))
    whole = large.groupBy("component").agg(F.count("*").alias("m")).join(pairs_of, "component").where("m * m <= by_heads").select(F.col("component").alias("whole"))
    own = own.join(broadcast_if_small(materialise(whole, "whole-blocks")), F.col("component") == F.col("whole"), "left")
    own = materialise(own.select("node", F.coalesce("whole", "head").alias("head")).distinct(), "groups")
    count = materialise(own.groupBy("head").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("chunks")), "head-sizes")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")
    cut = own.join(broadcast_if_small(count), "head").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("node", "head", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def compare(rows: pa.Table) -> pa.Table:
        node, size, part = (rows.column(c).to_numpy() for c in ("node", "n", "chunk"))
        bins = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), BINS)
        out = forest(node, near_sketches(bins, size, num, den), part)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return cut.join(broadcast_if_small(sketches, n_large), "node").groupBy("head", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; linked from num / den on."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialise(profiles(docs, width), "profiles")
    named = profile.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h", "n", "d1", "d2")).alias("r"), F.max("h").alias("last"))
    other = materialise(named.where("r.h <> last").select("doc_id", "r.h"), "ids-of-several-texts")
    if other.limit(1).count():
        texts = docs.withColumn("h", F.xxhash64("text")).join(broadcast_if_small(other.withColumnRenamed("h", "own")), "doc_id", "left")
        docs = texts.where("own IS NULL OR h = own").select("doc_id", "text")
    real = named.where("r.n > 0").select("doc_id", "r.n", "r.d1", "r.d2")
    copies = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("d1", "d2", "node")
    copies = materialise(copies, "copies")
    # (d1, d2) of copies is unique, so the join keeps the rows; what is no smallest copy emits no keys.
    twins = materialise(real.join(broadcast_if_small(copies), ["d1", "d2"]).select("doc_id", "node"), "twins")
    spare = twins.where("doc_id <> node").select("doc_id").distinct()
    single = docs.where("doc_id IS NOT NULL").join(broadcast_if_small(spare), "doc_id", "left_anti")
    by_key = W.partitionBy("key").orderBy("node")
    shared = postings(single, width, num, den).withColumn("head", F.first("node").over(by_key)).where("head <> node")
    pairs = shared = materialise(shared.select("node", "head").distinct(), "heads")
    # A node's heads are tied to the smallest of them instead of each to the node: as connected, with far fewer
    # edges where near copies share many keys. A node has no more heads than keys, so its window is small.
    least = shared.withColumn("least", F.min("head").over(W.partitionBy("node")))
    tied = F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("least").alias("b")), F.struct(F.col("head").alias("a"), F.col("least").alias("b")))).alias("e")
    shared = materialise(least.select(tied).select("e.a", "e.b").where("a <> b").distinct(), "shared-keys")
    blocks = components(shared)
    large = blocks.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("component")
    large = materialise(blocks.join(broadcast_if_small(materialise(large, "large")), "component", "left_semi"), "large-blocks")
    if large.limit(1).count():
        rest = blocks.join(large.select("component").distinct(), "component", "left_anti")
        blocks = materialise(rest.unionByName(components(refined(docs, pairs, large, width, num, den))), "refined-blocks")
    found = materialise(verified_links(docs, blocks, real.select("doc_id", "n"), width, num, den), "links")
    labels = components(found)
    # Copies go with their node, a node with its component.
    groups = twins.join(broadcast_if_small(labels), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    groups = materialise(groups.union(labels.select(F.col("node").alias("doc_id"), "component")).distinct(), "groups")
    return profile.join(broadcast_if_small(groups), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, linked from 0.9 on."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS meet FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * meet >= 90 * (x.n + y.n - meet)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""
