"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of character classes, word lengths, word and line
repetition and length, cut at fixed thresholds, of the line and of its two neighbours. Training labels
come by document: lines take their document's label; after a first fit the lines of bad documents that
look good on their own are relabelled and the field is fitted again. A document's quality is the mean of
its lines' forward-backward marginals weighted by line length, put through a logistic calibration.

The model is fitted in numpy on the driver from a bounded sample (`train_rows` labelled documents in
hashed order, of at most `train_chars` characters each); scoring covers every whole text, in Arrow
batches, with arrays of a bounded number of characters at a time (or of one text, if it is longer).

Cases: null and empty texts are one empty line; repeated rows each get a row; empty tables give an empty
result; without labels of both kinds scores are the label's share (0.5 without any); other columns are
ignored by the score and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.session import table

TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
THRESHOLD = 0.7
CUTS = np.array([0.02, 0.08, 0.2, 0.4, 0.7], np.float32)
LENGTH_CUTS = np.array([0.5, 2.5, 5.5, 12.5, 30.5, 100.5], np.float32)
PIECE_CHARS = 2_000_000
_NAMES = ("upper", "digit", "noise", "bar", "shout", "comma", "other", "same word", "word before last", "long words", "short words", "same line", "no capital", "no stop")
_UPPER, _LOWER, _DIGIT, _NOISE, _BAR, _SHOUT, _COMMA, _SPACE, _LETTER = range(9)


def _class_table() -> np.ndarray:
    """Character classes below 0x3000 (letters of any script above count as letters)."""
    out = np.full(0x3000, 9, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isupper():
            out[i] = _UPPER
        elif c.islower():
            out[i] = _LOWER
        elif c.isalpha():
            out[i] = _LETTER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isspace():
            out[i] = _SPACE
    for k, chars in ((_NOISE, "#$%&*+<=>@[\\]^_`{}~/"), (_BAR, "|"), (_SHOUT, "!?"), (_COMMA, ".,;:'\"()-–—«»¿¡…")):
        for c in chars:
            out[ord(c)] = k
    return out


CLASSES = _class_table()
_POWERS = np.cumprod(np.concatenate([[1], np.full(63, 0x9E3779B97F4A7C15, np.uint64)]).astype(np.uint64), dtype=np.uint64)
N_FEATURES = 3 * (len(_NAMES) * len(CUTS) + len(LENGTH_CUTS)) + 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths, number of lines of each text)."""
    whole = "\n".join(texts) + "\n"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 0x3000, CLASSES[np.minimum(code, 0x2FFF)], np.uint8(_LETTER))
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)  # noqa: E731  the line's end belongs to it
    solid = kind != _SPACE
    chars = np.maximum(count(solid), 1)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = np.flatnonzero(first)
    words = count(first)
    share = {k: count(kind == k) / chars for k in (_UPPER, _DIGIT, _NOISE, _BAR, _SHOUT, _COMMA, 9)}
    line_of = np.searchsorted(ends, begin)
    if len(begin):
        gap = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
        size = gap - begin
        at = np.flatnonzero(solid)
        offset = np.minimum(at - np.repeat(begin, size), 63)
        own = (code[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7)) * _POWERS[offset]
        h = np.add.reduceat(own, np.concatenate([[0], np.cumsum(size)[:-1]]))
        same1 = np.zeros(len(begin), bool)
        same2 = same1.copy()
        same1[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        same2[2:] = (h[2:] == h[:-2]) & (line_of[2:] == line_of[:-2])
        per = lambda v: np.bincount(line_of, v, len(starts)) / np.maximum(words, 1)
        same1, same2, long, short = per(same1), per(same2), per(size > 16), per(size < 3)
        line_hash = np.bincount(line_of, (h >> np.uint64(40)).astype(np.float64), len(starts))
        capital = (kind[begin] == _UPPER).astype(np.float64)
        head = np.zeros(len(starts))
        head[line_of[::-1]] = capital[::-1]
    else:
        same1 = same2 = long = short = line_hash = head = np.zeros(len(starts))
    doc = np.repeat(np.arange(len(texts)), n_lines)
    again = np.zeros(len(starts))
    order = np.lexsort((line_hash, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1]) & (words[order][1:] > 2)
    again[order[1:]] = twin
    stop = np.isin(code[np.maximum(ends - 1, 0)], np.array([ord(c) for c in ".!?:;\"')"], np.uint32))
    raw = np.stack([*(share[k] for k in (_UPPER, _DIGIT, _NOISE, _BAR, _SHOUT, _COMMA, 9)), same1, same2, long, short, again, 1 - head, 1.0 - stop], 1).astype(np.float32)
    on = np.concatenate([(raw[:, :, None] > CUTS).reshape(len(raw), -1), words[:, None] > LENGTH_CUTS], 1)
    before, after = np.zeros_like(on), np.zeros_like(on)
    before[1:], after[:-1] = on[:-1], on[1:]
    edge = np.cumsum(n_lines)
    before[np.concatenate([[0], edge[:-1]])] = False
    after[edge - 1] = False
    return np.concatenate([on, before, after, np.ones((len(on), 1), bool)], 1), np.maximum(ends - starts, 1), n_lines


@dataclass
class LineField:
    """weights: evidence for bad; step[i, j]: log potential of j after i (0 good, 1 bad); a, b: calibration; base: the score without a model."""

    weights: np.ndarray
    step: np.ndarray
    a: float = 1.0
    b: float = 0.0
    base: float | None = None

    def marginals(self, evidence: np.ndarray, n_lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line and, if asked, the expected number of each pair of states, by forward-backward over all texts at once."""
        order = np.argsort(-n_lines, kind="stable")
        start = (np.cumsum(n_lines) - n_lines)[order]
        sizes = n_lines[order]
        bad = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        psi = np.stack([1 - bad, bad], 1)
        step = np.exp(self.step - self.step.max())
        forward, back = np.empty_like(psi), np.empty_like(psi)
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")  # texts with more than t lines
        for t, k in enumerate(live):
            at = start[:k] + t
            x = psi[at] if t == 0 else (forward[at - 1] @ step) * psi[at]
            forward[at] = x / x.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(live) - 1, -1, -1):
            k, more = live[t], live[t + 1] if t + 1 < len(live) else 0
            at = start[:k] + t
            x = np.full((k, 2), 0.5)
            if more:
                nxt = psi[at[:more] + 1] * back[at[:more] + 1]
                y = nxt @ step.T
                x[:more] = y / y.sum(1, keepdims=True)
                if pairs:
                    xi = forward[at[:more]][:, :, None] * step * nxt[:, None, :]
                    expected += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
            back[at] = x
        both = forward * back
        return both[:, 1] / both.sum(1), expected

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted share of good lines."""
        x, size, n = line_features(texts)
        p, _ = self.marginals(x @ self.weights, n)
        first = np.cumsum(n) - n
        return np.add.reduceat((1 - p) * size, first) / np.add.reduceat(size.astype(float), first)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        q = np.clip(self.quality(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.a * np.log(q / (1 - q)) + self.b)))


def _fit_field(x: np.ndarray, y: np.ndarray, n_lines: np.ndarray, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> LineField:
    """Conditional likelihood by Adam over all lines."""
    model = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    xs = x.astype(np.float32)
    first = np.zeros(len(y), bool)
    first[np.cumsum(n_lines) - n_lines] = True
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    moment = [np.zeros(x.shape[1] + 4) for _ in range(2)]
    for k in range(1, steps + 1):
        p, expected = model.marginals(xs @ model.weights.astype(np.float32), n_lines, pairs=True)
        g = np.concatenate([xs.T @ (y - p).astype(np.float32), (seen - expected).ravel()]) / len(y)
        g -= decay * np.concatenate([model.weights, model.step.ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.99 * moment[1] + 0.01 * g * g
        move = rate * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        model.weights += move[:-4]
        model.step += move[-4:].reshape(2, 2)
    return model


def fit(texts: list[str], good: np.ndarray) -> LineField:
    """A field from documents with labels 1 (good) or 0."""
    good = np.asarray(good, np.int64)
    if len(set(good.tolist())) < 2:
        return LineField(np.zeros(N_FEATURES), np.zeros((2, 2)), base=float(good[0]) if len(good) else 0.5)
    x, _, n = line_features(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    y = 1 - good[doc]
    model = _fit_field(x, y, n)
    # Lines of bad documents whose own evidence says good are relabelled; each bad document keeps its worst line.
    own = x @ model.weights
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, doc, own)
    model = _fit_field(x, np.where((own < 0) & (own < worst[doc]), 0, y), n)
    q = np.clip(model.quality(texts), 1e-4, 1 - 1e-4)
    z, a, b = np.log(q / (1 - q)), 1.0, 0.0
    for _ in range(60):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        d = np.linalg.solve(h, np.array([((good - p) * z).sum() - (a - 1), (good - p).sum() - 1e-2 * b]))
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    model.a, model.b = max(a, 1e-3), b
    return model


def training_sample(docs: DataFrame, labels: DataFrame, column: str, keep: object, rows: int, chars: int) -> tuple[list[str], np.ndarray]:
    """At most `rows` labelled documents in hashed order of doc_id, of at most `chars` characters, with their labels. An id
    of several texts gives its least one."""
    known = labels.where(keep).where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("_label"))
    light = docs.where(F.length("text") <= chars).select("doc_id")
    ids = known.join(light, "doc_id", "left_semi").select("doc_id", "_label", F.xxhash64("doc_id").alias("_o")).orderBy("_o", "doc_id").limit(rows)
    # At most `rows` rows, so the broadcast and what the driver gets are bounded, however often an id is repeated.
    own = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
    got = sorted((r["doc_id"], r["text"], r["_label"]) for r in own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label")).collect())
    return [t for _, t, _ in got], np.array([y for _, _, y in got], np.int64)


def pieces(texts: list[str], most: int = PIECE_CHARS) -> Iterator[slice]:
    """Slices of texts of at most `most` characters (or one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def free_name(docs: DataFrame, name: str) -> str:
    """name, or the first of _name, __name, ... that is no column."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name = "_" + name
    return name


def score_column(docs: DataFrame, model: object, name: str = "score") -> DataFrame:
    """docs with a new column from model.score, a batch of whole texts at a time; its name must be free."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = np.concatenate([np.zeros(0), *(held.value.score(texts[s]) for s in pieces(texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame, keep: object, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> LineField:
    return fit(*training_sample(docs, labels, "quality", keep, rows, chars))


def remainder(modulus: int) -> object:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole document; labels with remainder 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = score_column(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
