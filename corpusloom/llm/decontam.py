"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased words (runs of word characters). A mask is a fixed pattern over SPAN tokens that
looks at some positions and ignores the others, so a hash of what it sees survives substitutions at the
ignored ones. Every position of every benchmark item is hashed under every mask; so is every position of
every training document, and equal hashes are joined. A hit fixes a diagonal (document position less item
position), along which the whole item is compared: some segment must match at least `least` tokens, or
`share` of the item if that is less, at `identity`. Reported is the segment with the best score (a match gains
1, a mismatch loses PENALTY) if it does, else the one that does with the most matches.

The masks leave out no such segment at the default bounds (or stricter ones): items of 15 tokens or more are
hashed under MASKS, of which one at least is whole in any segment of 12 matches at 0.8 (the tests prove it),
shorter items under those of SHORT for their length, and items under 5 tokens, which must match whole, whole.

The benchmark goes to the tasks in blocks of bounded size (a hash join whose build side is one block);
every document is read whole against every block, so there is no shuffle of documents and a passage that
a third of them hold is no hot key. A document's rows depend on it alone.

Cases: null and empty texts and items match nothing; repeated rows each give rows; items that repeat a
text are each reported; a null item_id is kept (ids are longs, or texts that hold one); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import materialise
from corpusloom.session import table

WORD = re.compile(r"\w+")
#: Fixed masks (1: looked at), found by search.
MASKS = ("11111011", "10101001111", "11100101011", "1100100100111", "1111100011", "1001101010101")
#: Masks of items that have at least so many tokens and fewer than the next: one mismatch from 5 on, two from 10 on.
SHORT = {
    5: ("111", "1101"),
    8: ("1101111", "111111", "1111011"),
    10: ("1111011", "11001111", "110110011", "10101111", "11110101"),
    13: ("111011111", "1111101011", "11010011111", "111001100111", "1001110110011"),
}
LONG = 15
LEAST, SHARE, IDENTITY, PENALTY = 12, 0.8, 0.8, 3
#: Tokens of a benchmark block (some 60 bytes each with its hashes), and of a piece of documents hashed at once.
BLOCK_TOKENS, PIECE_TOKENS = 1_000_000, 1 << 19
SCHEMA = "item_id long, n_matched long, identity double, doc_start long, doc_end long, item_start long"
_FIELDS = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """One block of benchmark items with the hashes of all their masked positions."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS) -> None:
        self.words: dict[str, int] = {}
        self.items, seqs = [], []
        for item_id, text in items:
            if words := WORD.findall((text or "").lower()):
                self.items.append(item_id)
                seqs.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.int64))
        self.seqs = seqs
        self.code = _mix(np.arange(len(self.words) + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        least = [*range(1, min(SHORT)), *SHORT, LONG]
        tiers = [max(n for n in least if n <= len(s)) for s in seqs]
        used = [(tier, m) for tier in sorted(set(tiers)) for m in (masks if tier == LONG else SHORT.get(tier, ("1" * tier,)))]
        self.masks = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for _, m in used]
        self.spans = [len(m) for _, m in used]
        self.tables = []
        for k, (tier, _) in enumerate(used):
            own = [(i, s) for i, s in enumerate(seqs) if tiers[i] == tier]
            h = [self.hashes(s, k) for _, s in own]
            key = np.concatenate([np.zeros(0, np.uint64), *h])
            item = np.repeat(np.array([i for i, _ in own], np.int64), [len(x) for x in h])
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in h)])
            o = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 18, bool)
            bits[(key >> np.uint64(46)).astype(np.int64)] = True
            self.tables.append((key[o], item[o], at[o], bits))

    def hashes(self, ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - self.spans[k] + 1
        code, out = self.code[ids], np.zeros(max(n, 0), np.uint64)
        for j, at in enumerate(self.masks[k]):
            out += code[at : at + n] * np.uint64(2 * j * 0x9E3779B97F4A7 + 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        return out

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """(item, diagonal, position) rows of the hits in a run of token ids."""
        found = []
        for k, (key, item, at, bits) in enumerate(self.tables):
            if not len(key) or len(ids) < self.spans[k]:
                continue
            h = self.hashes(ids, k)
            p = np.flatnonzero(bits[(h >> np.uint64(46)).astype(np.int64)])
            low, high = np.searchsorted(key, h[p], "left"), np.searchsorted(key, h[p], "right")
            n = high - low
            if n.any():
                rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                at_doc = np.repeat(p, n)
                found.append(np.stack([item[rows], at_doc - at[rows], at_doc], 1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def best_segment(same: np.ndarray, penalty: int = PENALTY) -> tuple[int, int]:
    """Bounds of the segment with the highest score (matches less penalty times mismatches)."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.argmin(total[: end + 1])), end


def longest_segment(same: np.ndarray, identity: Fraction) -> tuple[int, int]:
    """Bounds of the segment at `identity` with the most matches, without mismatches at its ends."""
    total = np.concatenate([[0], np.cumsum(np.where(same, identity.denominator - identity.numerator, -identity.numerator))])
    low = np.minimum.accumulate(total)
    starts = np.searchsorted(-low, -total, "left")  # of the longest segment up to each end
    count = np.concatenate([[0], np.cumsum(same)])
    end = int(np.argmax(count - count[starts]))
    at = np.flatnonzero(same[starts[end] : end]) + starts[end]
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def overlaps(block: Block, ids: np.ndarray, offset_hits: np.ndarray, least: int, share: float, identity: float) -> dict[int, tuple]:
    """The best verified overlap with each item, from one document's ids and hits."""
    best: dict[int, tuple] = {}
    bound = Fraction(str(identity))
    for i, diagonal in offset_hits.tolist():
        seq = block.seqs[i]
        a, b = max(0, -diagonal), min(len(seq), len(ids) - diagonal)
        if b <= a:
            continue
        same = ids[diagonal + a : diagonal + b] == seq[a:b]
        for s, e in (best_segment(same), longest_segment(same, bound)):
            n = int(same[s:e].sum())
            if n and n >= min(least, math.ceil(share * len(seq))) and n >= bound * (e - s):
                if i not in best or n > best[i][0]:
                    best[i] = (n, n / (e - s), diagonal + a + s, diagonal + a + e, a + s)
                break
    return best


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, identity: float = IDENTITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document (a doc_id of any type) and benchmark item that it overlaps: tokens matched, identity, and where."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    tokens = items.agg(F.sum(F.size(F.split("text", r"(?U)\W+")))).first()[0] or 0
    n_blocks = max(1, math.ceil(tokens / block_tokens))
    texts = docs.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType
    key = to_arrow_type(kind)

    def one(k: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        rows = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        held = spark.sparkContext.broadcast(Block(rows))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            gap = np.zeros(max(block.spans, default=1), np.int64)  # id 0 is in no item, so no hash spans two documents
            get = block.words.get
            for batch in batches:
                out: list[tuple] = []
                group: list[tuple[int | None, np.ndarray]] = []
                held_tokens = 0

                def flush() -> None:
                    starts, parts, at = [], [], 0
                    for _, ids in group:
                        starts.append(at)
                        parts += [ids, gap]
                        at += len(ids) + len(gap)
                    whole, begins = np.concatenate(parts), np.array(starts)
                    lap, seen = len(gap) - 1, []
                    for p in range(0, len(whole), PIECE_TOKENS):
                        h = block.hits(whole[p : p + PIECE_TOKENS + lap])
                        h[:, 1:] += p
                        # The hit's position lies in its document; its diagonal may begin before it and end after it.
                        h[:, 2] = np.searchsorted(begins, h[:, 2], "right") - 1
                        seen.append(np.unique(h, axis=0))
                    hits = np.concatenate(seen)
                    hits = hits[np.argsort(hits[:, 2], kind="stable")]
                    for mine in np.split(hits, np.flatnonzero(np.diff(hits[:, 2])) + 1) if len(hits) else []:
                        d = int(mine[0, 2])
                        doc_id, ids = group[d]
                        own = np.unique(mine[:, :2] - [0, starts[d]], axis=0)
                        for i, found in sorted(overlaps(block, ids, own, least, share, identity).items()):
                            out.append((doc_id, block.items[i], *found))

                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    ids = np.array([get(w, 0) for w in WORD.findall((text.as_py() or "").lower())], np.int64)
                    group.append((doc_id.as_py(), ids))
                    held_tokens += len(ids)
                    if held_tokens >= PIECE_TOKENS:
                        flush()
                        group, held_tokens = [], 0
                if group:
                    flush()
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = [key, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], _FIELDS)

        found = texts.mapInArrow(probe, f"doc_id {kind.simpleString()}, {SCHEMA}")
        if n_blocks == 1:
            return found
        found = materialise(found, "overlaps")  # so that one block at a time is broadcast
        held.destroy()
        return found

    out = one(0)
    for k in range(1, n_blocks):
        out = out.union(one(k))
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
