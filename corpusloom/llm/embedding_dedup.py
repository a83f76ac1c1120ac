"""Embedding near-duplicates by a subspace pigeonhole join, exact.

Unit vectors with cosine >= t have squared distance <= 2 (1 - t). After a fixed random rotation, which
spreads the distance over all coordinates, a vector is split into blocks of BLOCK coordinates. A block's
budget is its share of that squared distance in proportion to its coordinates, and the budgets add up to
the whole, so two linked vectors keep within the budget in some block. Each block is range-joined, and what
it finds is verified by the cosine of the whole vectors in double precision. A pair counts in the first
block whose budget it keeps, so no table of pairs is made: tasks give each vector its number of links, and
edges that span what they linked.

The range join of a block is a tree of cells that halve the vectors at medians of a sample, one coordinate
after the other. A vector lies in its home cell and probes every later cell whose squared distance from it,
added up over the cuts between, is within the budget. There are as many cells as hold some CELL vectors each,
so the tasks keep their size as vectors grow in number. Within a task the tree goes on down to LEAF vectors,
each with the probes within the budget of its box, and only those are compared, as one matrix product.

Equal vectors are collapsed first and counted, so copies cost nothing. A cell's vectors are cut into chunks
of bounded size (many near copies lie in one cell) and each pair of chunks is a task of its own. True links
are all made, since each counts. The medians are those of a sample (vectors whose hash is under a bound, some
SAMPLE at most); they set the shape of the cells, never what is found.

Cases: null vectors, zero vectors and those with null or non-finite components link with nothing, nor do
vectors of different lengths; a null vec_id gets no links and no component; repeated rows count as
vectors of their own with one id; ties fall to the smallest id; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, components, materialise
from corpusloom.session import table

BLOCK, SEED = 16, 11
#: Vectors of a cell of the shuffled tree, of a chunk of a cell, and of a leaf within a task; pairs verified at once.
CELL, CHUNK, LEAF, PAIRS = 8192, 32_768, 192, 1 << 15
#: Vectors of one length that set the cuts, at most, and for each cell.
SAMPLE, SAMPLE_CELL = 1 << 16, 256
#: Slack for rounding in the rotation, and in single precision; candidates are verified, so more is only more work.
SLACK, SLACK32 = 1e-9, 1e-5
#: A block's tree of cells: for each level the coordinate that is cut, and the cut of each cell of the level before.
Tree = list[tuple[int, np.ndarray]]


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    return [slice(s, min(s + BLOCK, dim)) for s in range(0, dim, BLOCK)]


def radius2(dim: int, block: slice, cosine: float) -> float:
    return 2 * (1 - cosine) * (block.stop - block.start) / dim + SLACK


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def members(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim, d1, d2): valid vectors with their length and digest, nulls for others."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    ok = v.isNotNull() & F.coalesce(finite, F.lit(False)) & (norm2 > 0) & F.col("vec_id").isNotNull()
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.col("embedding") if single else v).alias("v"))
    # 0.0 and -0.0 are one value to the digest.
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    return rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), F.xxhash64(plain).alias("d1"), F.xxhash64(F.lit(3), plain).alias("d2"))


def plant(x: np.ndarray, levels: int) -> Tree:
    """A tree of so many levels over block coordinates, cut at medians."""
    cell, tree = np.zeros(len(x), np.int64), []
    for level in range(levels):
        axis = level % x.shape[1]
        cuts = np.zeros(1 << level)
        order = np.argsort(cell, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            cuts[cell[mine[0]]] = np.median(x[mine, axis])
        tree.append((axis, cuts))
        cell = 2 * cell + (x[:, axis] > cuts[cell])
    return tree


def home_cells(x: np.ndarray, tree: Tree) -> np.ndarray:
    cell = np.zeros(len(x), np.int64)
    for axis, cuts in tree:
        cell = 2 * cell + (x[:, axis] > cuts[cell])
    return cell


def reached(x: np.ndarray, tree: Tree, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of each row's home cell and of the later cells within the limit of it."""
    row, cell, gap, before = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(x.shape), np.zeros(len(x), bool)
    for axis, cuts in tree:
        step = x[row, axis] - cuts[cell]
        near = (step > 0).astype(np.int64)
        across = gap.copy()
        across[:, axis] = np.maximum(gap[:, axis], np.abs(step))
        # The other child is off the way home only where this cell is still on it; an earlier one is not probed.
        keep = ((across**2).sum(1) <= limit) & (before | (near == 0))
        row, gap = np.concatenate([row, row[keep]]), np.concatenate([gap, across[keep]])
        cell = np.concatenate([2 * cell + near, 2 * cell[keep] + 1 - near[keep]])
        before = np.concatenate([before, np.ones(int(keep.sum()), bool)])
    return row, cell, ~before


def leaves(x: np.ndarray, home: np.ndarray, probe: np.ndarray, limit: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors of a leaf, vectors near its box): each probe and home within the limit meet once, and if `within` so do homes of two leaves."""
    stack = [(home, probe)]
    while stack:
        home, probe = stack.pop()
        low, high = x[home].min(0), x[home].max(0)
        gap = x[probe]
        gap = np.maximum(np.maximum(low - gap, gap - high), 0)
        probe = probe[np.einsum("ij,ij->i", gap, gap) <= limit]
        if len(home) <= LEAF:
            yield home, probe
            continue
        order = np.argpartition(x[home, int(np.argmax(high - low))], len(home) // 2)
        left, right = home[order[: len(home) // 2]], home[order[len(home) // 2 :]]
        stack += [(left, np.concatenate([probe, right]) if within else probe), (right, probe)]


class Forest:
    """Connected sets of so many nodes, from pairs that come in parts."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (further := self.label[self.label])).any():
                self.label = further


class Linker:
    """The links of one block among the vectors of one task."""

    def __init__(self, rows: np.ndarray, copies: np.ndarray, block: int, cosine: float) -> None:
        self.block, self.cosine, self.copies = block, cosine, copies
        self.u = unit(rows)
        dim = self.u.shape[1]
        self.x = self.u @ rotation(dim)
        self.blocks = blocks_of(dim)
        self.limits = [radius2(dim, s, cosine) for s in self.blocks]
        self.others = np.zeros(len(rows), np.int64)
        self.forest = Forest(len(rows))

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this block is the first whose budget the pairs keep; the same in every task, to the last bit."""
        ok = np.ones(len(i), bool)
        for b in range(self.block + 1):
            d = self.x[i, self.blocks[b]] - self.x[j, self.blocks[b]]
            within = (d * d).sum(1) <= self.limits[b]
            ok &= within if b == self.block else ~within
        return ok

    def verify(self, i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            near = (self.u[a] * self.u[b]).sum(1) >= self.cosine
            a, b = a[near], b[near]
            ok = self.first(a, b)
            a, b = a[ok], b[ok]
            np.add.at(self.others, a, self.copies[b])
            np.add.at(self.others, b, self.copies[a])
            self.forest.add(a, b)

    def run(self, home: np.ndarray, probe: np.ndarray, within: bool) -> None:
        """Compares homes with probes, and if `within` with each other."""
        if not len(home):
            return
        limit = self.limits[self.block]
        x = self.x[:, self.blocks[self.block]].astype(np.float32)
        n2 = (x * x).sum(1)
        for mine, others in leaves(x, home, probe, limit + SLACK32, within):
            for near in (others, mine) if within else (others,):
                d2 = n2[mine][:, None] + n2[near] - 2 * (x[mine] @ x[near].T)
                i, j = np.nonzero(d2 <= limit + SLACK32)
                if near is mine:
                    i, j = i[i < j], j[i < j]
                self.verify(mine[i], near[j])


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length from a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def planted(nodes: DataFrame, sizes: dict[int, int], cell: int) -> dict[int, list[Tree]]:
    """For each length of vectors, the tree of each block; from a bounded sample."""
    out = {}
    for dim, n in sizes.items():
        levels = max(0, math.ceil(math.log2(n / cell)))
        out[dim] = [[] for _ in blocks_of(dim)]
        if levels:
            share = min(1.0, min(SAMPLE, SAMPLE_CELL << levels) / n)
            own = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))
            rows = nodes.where((F.col("dim") == dim) & own).select("v").toArrow()
            if len(rows):
                x = unit(vectors_of(rows.column("v"))) @ rotation(dim)
                out[dim] = [plant(x[:, s], levels) for s in blocks_of(dim)]
    return out


def cells(nodes: DataFrame, cosine: float, trees: dict[int, list[Tree]], counts: bool) -> DataFrame:
    """Every node with its vector in each block, in its home cell and as a probe in later cells; or only how many are where."""
    names, kinds = ["dim", "block", "cell", "home", "node", "copies"], [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                for part in np.array_split(which, math.ceil(len(which) / 500)):
                    mine = batch.take(pa.array(part))
                    x = unit(vectors_of(mine.column("v"))) @ rotation(dim)
                    for b, s in enumerate(blocks_of(dim)):
                        yield dim, b, mine, *reached(x[:, s], trees[dim][b], radius2(dim, s, cosine))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b, mine, row, cell, home in places(batches):
            at, n = pa.array(row), len(row)
            own = [np.full(n, dim), np.full(n, b), cell, home]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(own, kinds, strict=False)), *(mine.column(c).take(at) for c in ("node", "copies", "v"))], [*names, "v"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[int]] = {}
        for dim, b, _, _, cell, home in places(batches):
            found, at = np.unique(cell, return_inverse=True)
            for c, all_, homes in zip(found.tolist(), np.bincount(at).tolist(), np.bincount(at, weights=home).astype(np.int64).tolist(), strict=True):
                total = held.setdefault((dim, b, c), [0, 0])
                total[0], total[1] = total[0] + homes, total[1] + all_
        cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*kinds[:3], pa.int64(), pa.int64()], strict=True)], ["dim", "block", "cell", "homes", "rows"])

    used = nodes.select("node", "copies", "dim", "v")
    if counts:
        return used.mapInArrow(count, "dim int, block int, cell long, homes long, rows long").groupBy("dim", "block", "cell").agg(F.sum("homes").alias("homes"), F.sum("rows").alias("rows"))
    return used.mapInArrow(emit, f"dim int, block int, cell long, home boolean, node long, copies long, v {nodes.schema['v'].dataType.simpleString()}")


def linked(nodes: DataFrame, cosine: float, trees: dict[int, list[Tree]]) -> DataFrame:
    """(node, n, other) rows: n further links of a node (other is null), or an edge of a spanning forest (n is 0)."""
    few = F.col("rows") <= CHUNK
    count = cells(nodes, cosine, trees, True).where("homes > 0")
    count = count.select("dim", "block", "cell", F.ceil(F.col("homes") / CHUNK).cast("int").alias("homes"), F.when(few, 0).otherwise(F.ceil((F.col("rows") - F.col("homes")) / CHUNK)).cast("int").alias("probes"))
    rows = cells(nodes, cosine, trees, False).join(broadcast_if_small(materialise(count, "cells")), ["dim", "block", "cell"])
    # Chunks of homes come first, then those of probes (in the only chunk of homes where the cell has few rows). Homes meet every chunk, probes those of homes.
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.greatest("probes", F.lit(1))).cast("long")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("home") | (F.col("probes") == 0), 0).otherwise(F.col("homes")) + own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("probes")).otherwise(F.col("homes")) - 1)))
    rows = rows.select("dim", "block", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "node", "copies", "v")

    def join(t: pa.Table) -> pa.Table:
        block, i, j = (t.column(c)[0].as_py() for c in ("block", "i", "j"))
        node, copies, home, own = (t.column(c).to_numpy() for c in ("node", "copies", "home", "own"))
        linker = Linker(vectors_of(t.column("v")), copies, block, cosine)
        if i == j:
            linker.run(np.flatnonzero(home), np.flatnonzero(~home), True)
        else:
            linker.run(np.flatnonzero(own == i), np.flatnonzero(own == j), False)
        some, tied = np.flatnonzero(linker.others), np.flatnonzero(linker.forest.label != np.arange(len(node)))
        n = np.concatenate([linker.others[some], np.zeros(len(tied), np.int64)])
        other = pa.array(np.concatenate([node[some], node[linker.forest.label[tied]]]), mask=np.arange(len(n)) < len(some))
        return pa.table({"node": node[np.concatenate([some, tied])], "n": n, "other": other})

    return rows.groupBy("dim", "block", "cell", "i", "j").applyInArrow(join, "node long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    all_rows = members(vectors.select("vec_id", "embedding"))
    nodes = all_rows.where("dim IS NOT NULL").groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = materialise(nodes, "vectors")
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    n = sum(sizes.values())
    found = materialise(linked(nodes, cosine, planted(nodes, sizes, cell)), "vector-links")
    degree = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("others"))
    labels = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = nodes.select("d1", "d2", "node", "copies").join(degree, "node", "left").join(labels, "node", "left")
    groups = materialise(groups.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-groups")
    out = all_rows.select("vec_id", "d1", "d2", F.col("dim").isNotNull().alias("valid")).join(broadcast_if_small(groups, n), ["d1", "d2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels, linked from cosine 0.95 on."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)"""
