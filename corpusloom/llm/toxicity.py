"""Toxicity from a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as words in overlapping windows (WINDOW words, a new one every STRIDE). A word enters as
its own vector (words of the training vocabulary) and the sum of the vectors of its hashed character
n-grams, so unseen forms are read by their spelling. A gated recurrent network runs each way, attention
pools its states, and a window's logit is linear in the pool. A document's score is that of its most
toxic window, calibrated to a probability. Labels are by document: in training a soft maximum over its
windows carries the gradient.

Training is on the driver over a bounded sample (`toxic_rows` and `clean_rows` labelled documents in
hashed order, of at most `chars` characters each) with a fixed number of steps. Scoring covers every
window of every whole text. Projections of known words are kept per worker in a table of bounded size.

Cases: null and empty texts are one empty window; repeated rows each get a row; empty tables give an
empty result; without labels of both kinds scores are the label's share (0 without any); other columns
are ignored by the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.quality import remainder, score_column, training_sample
from corpusloom.session import table

WORD = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 12, 8
BUCKETS, GRAMS, VOCABULARY = 1 << 14, (3, 4), 6000
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS, STEPS, BATCH, BATCH_WINDOWS = 1000, 1600, 12_000, 260, 80, 6
THRESHOLD = 0.5
#: Words whose projections a worker keeps (48 floats each), and windows run at once.
KEPT, RUN = 1 << 18, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every character n-gram of ^word$."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    index = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    buckets, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ code[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        buckets.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(index[at])
    return np.concatenate(buckets), np.concatenate(owners)


def _scatter(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    d = values.shape[1]
    return np.bincount((index[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)


def windows_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of texts with n_words each, laid end to end."""
    per = np.maximum(1, -(-(n_words - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(n_words)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    base = (np.cumsum(n_words) - n_words)[doc]
    return doc, base + k * STRIDE, np.minimum(WINDOW, n_words[doc] - k * STRIDE)


class Network:
    """The model; `p` holds its arrays."""

    def __init__(self, vocabulary: list[str], seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        make = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": make(len(vocabulary) + 1, WORD_DIM), "char": make(BUCKETS, CHAR_DIM), "wa": make(2 * HIDDEN, ATTENTION, s=0.3), "ba": make(ATTENTION, s=0.0), "va": make(ATTENTION, s=0.3), "wo": make(2 * HIDDEN, s=0.3), "bo": make(1, s=0.0)}
        for way in "fb":
            self.p |= {f"w{way}": make(d, 3 * HIDDEN, s=0.3), f"b{way}": make(3 * HIDDEN, s=0.0), f"u{way}": make(HIDDEN, 3 * HIDDEN, s=0.3)}
        self.a, self.b, self.base = 1.0, 0.0, None
        self._known: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_table")} | {"_known": None}

    def inputs(self, words: list[str], own: np.ndarray) -> tuple[np.ndarray, tuple]:
        bucket, owner = grams(words)
        scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(words)), 1)).astype(np.float32)[:, None]
        chars = _scatter(owner, self.p["char"][bucket], len(words)) * scale
        return np.concatenate([self.p["word"][own], chars], 1), (bucket, owner, scale)

    @staticmethod
    def run(gx: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States [T, B, H] of the recurrent network over projected inputs [T, B, 3H]; where mask is False the state stays."""
        t_max, n, _ = gx.shape
        out = np.empty((t_max, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        whole = mask.all(1)
        for t in range(t_max):
            hu = h @ u
            g = hu[:, : 2 * HIDDEN] + gx[t, :, : 2 * HIDDEN]
            np.negative(g, out=g)
            np.exp(g, out=g)  # states and weights are small: no overflow in float32 below 88
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            new = np.tanh(gx[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            nxt = new + z * (h - new)
            if not whole[t]:
                nxt = np.where(mask[t][:, None], nxt, h)
            if keep is not None:
                keep.append((h, z, r, new, hu[:, 2 * HIDDEN :]))
            out[t] = h = nxt
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of windows from states [T, B, 2H]."""
        p = self.p
        a = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], -1e9)
        w = np.exp(e - e.max(0)) * mask
        w /= np.maximum(w.sum(0), 1e-9)
        context = np.einsum("tb,tbh->bh", w, states)
        return context @ p["wo"] + p["bo"][0], (a, w, context)

    def gradients(self, ids: np.ndarray, mask: np.ndarray, words: list[str], own: np.ndarray, outer: object) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients; ids [T, B] index words; outer(logits) gives (loss, d loss / d logits)."""
        p, g = self.p, {}
        x, (bucket, owner, scale) = self.inputs(words, own)
        kept: dict[str, list] = {"f": [], "b": []}
        flip = slice(None, None, -1)
        f = self.run((x @ p["wf"] + p["bf"])[ids], mask, p["uf"], kept["f"])
        b = self.run((x @ p["wb"] + p["bb"])[ids[flip]], mask[flip], p["ub"], kept["b"])[flip]
        states = np.concatenate([f, b], 2)
        logits, (a, w, context) = self.pool(states, mask)
        loss, d = outer(logits)
        d = d.astype(np.float32)
        g["wo"], g["bo"] = context.T @ d, d.sum(keepdims=True)
        dc = d[:, None] * p["wo"]
        ds = w[:, :, None] * dc
        dw = np.einsum("tbh,bh->tb", states, dc)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tba,tb->a", a, de)
        g["wa"], g["ba"] = np.einsum("tbh,tba->ha", states, da), da.sum((0, 1))
        ds = ds + da @ p["wa"].T
        dx = np.zeros_like(x)
        for way, part, order, m in (("f", ds[:, :, :HIDDEN], ids, mask), ("b", ds[flip][:, :, HIDDEN:], ids[flip], mask[flip])):
            u, du, dh = p["u" + way], np.zeros_like(p["u" + way]), np.zeros(part.shape[1:], np.float32)
            dgx = np.empty((*order.shape, 3 * HIDDEN), np.float32)
            for t in range(len(order) - 1, -1, -1):
                h, z, r, new, hn = kept[way][t]
                top = (dh + part[t]) * m[t][:, None]
                dn = top * (1 - z) * (1 - new * new)
                dz, dr = top * (h - new) * z * (1 - z), dn * hn * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], 1)
                dgx[t] = np.concatenate([dz, dr, dn], 1)
                du += h.T @ back
                dh = np.where(m[t][:, None], top * z + back @ u.T, dh + part[t])
            by_word = _scatter(order.ravel(), dgx.reshape(-1, 3 * HIDDEN), len(words))
            g["u" + way], g["b" + way], g["w" + way] = du, by_word.sum(0), x.T @ by_word
            dx += by_word @ p["w" + way].T
        g["word"] = _scatter(own, dx[:, :WORD_DIM], len(p["word"]))
        g["char"] = _scatter(bucket, (dx[:, WORD_DIM:] * scale)[owner], BUCKETS)
        return loss, g

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Rows of the projection table; new words are added, and the table starts anew when it is full."""
        if self._known is None:
            self._known, self._table = {}, np.zeros((KEPT, 6 * HIDDEN), np.float32)
        known = self._known
        new = list({w for w in words if w not in known})
        if len(known) + len(new) >= len(self._table):
            known.clear()
            new = list(set(words))
            if len(new) >= len(self._table):
                self._table = np.zeros((len(new) + 1, 6 * HIDDEN), np.float32)
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            x, _ = self.inputs(part, np.array([self.words.get(w, 0) for w in part], np.int64))
            first = len(known) + 1  # row 0 stands for no word
            self._table[first : first + len(part)] = np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], 1)
            known.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text."""
        split = [WORD.findall(t.lower()) for t in texts]
        rows = np.append(self._lookup([w for s in split for w in s]), 0)
        doc, start, size = windows_of(np.array([len(s) for s in split], np.int64))
        out = np.full(len(texts), -np.inf)
        t = np.arange(WINDOW)[:, None]
        for k in range(0, len(doc), RUN):
            at = slice(k, k + RUN)
            mask = t < size[at]
            ids = np.where(mask, rows[np.minimum(start[at] + t, len(rows) - 1)], 0)
            f = self.run(self._table[:, : 3 * HIDDEN][ids], mask, self.p["uf"])
            b = self.run(self._table[:, 3 * HIDDEN :][ids[::-1]], mask[::-1], self.p["ub"])[::-1]
            np.maximum.at(out, doc[at], self.pool(np.concatenate([f, b], 2), mask)[0])
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        return _sigmoid(self.a * self.logits(texts) + self.b)


def fit(texts: list[str], toxic: np.ndarray, prior: float | None = None, steps: int = STEPS, seed: int = 7, rate: float = 0.01) -> Network:
    """A network from documents with labels 1 (toxic) or 0; prior: the share of toxic documents outside the sample."""
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        model = Network([])
        model.base = float(toxic[0]) if len(toxic) else 0.0
        return model
    split = [WORD.findall(t.lower()) for t in texts]
    spread = Counter(w for s in split for w in set(s))
    model = Network(sorted(w for w, n in sorted(spread.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3), seed)
    r = np.random.default_rng(seed)
    doc, start, size = windows_of(np.array([len(s) for s in split], np.int64))
    flat = [w for s in split for w in s]
    by_doc = np.split(np.arange(len(doc)), np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
    sides = [np.flatnonzero(toxic == k) for k in (0, 1)]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(s, min(len(s), BATCH // 2), replace=False) for s in sides])
        rows = [r.permutation(by_doc[d])[:BATCH_WINDOWS] for d in chosen]
        win, owner = np.concatenate(rows), np.repeat(np.arange(len(chosen)), [len(x) for x in rows])
        words: dict[str, int] = {}
        ids = np.zeros((WINDOW, len(win)), np.int64)
        for j, k in enumerate(win):
            ids[: size[k], j] = [words.setdefault(w, len(words)) for w in flat[start[k] : start[k] + size[k]]]
        if not words:
            continue
        mask = np.arange(WINDOW)[:, None] < size[win]
        # Some words are read by their spelling alone, as unseen ones will be.
        own = np.array([model.words.get(w, 0) for w in words], np.int64) * (r.random(len(words)) > 0.4)
        y = toxic[chosen]

        def outer(s: np.ndarray, y: np.ndarray = y, owner: np.ndarray = owner) -> tuple[float, np.ndarray]:
            e = np.exp(2 * (s - np.array([s[owner == d].max() for d in range(len(y))])[owner]))
            w = e / np.bincount(owner, e, len(y))[owner]
            p = _sigmoid(np.bincount(owner, w * s, len(y)))
            loss = -np.mean(np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
            return float(loss), w * ((p - y) / len(y))[owner]

        _, g = model.gradients(ids, mask, list(words), own, outer)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * (1 if step < 0.7 * steps else 0.3)
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            m, s = moment[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            model.p[k] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    z = model.logits(texts)
    odds = (prior / (1 - prior) if prior and prior < 1 else toxic.mean() / (1 - toxic.mean())) / (toxic.sum() / (1 - toxic).sum())
    weight, a, b = np.where(toxic == 1, odds, 1.0), 1.0, 0.0
    for _ in range(60):  # Newton steps of a weighted logistic regression, shrunk towards the network's own logits
        p = _sigmoid(a * z + b)
        w = weight * p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        d = np.linalg.solve(h, np.array([(weight * (toxic - p) * z).sum() - (a - 1), (weight * (toxic - p)).sum() - 1e-2 * b]))
        a, b = a + float(np.clip(d[0], -0.5, 0.5)), b + float(np.clip(d[1], -0.5, 0.5))
    model.a, model.b, model._known = max(a, 1e-3), b, None
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, keep: object, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, chars: int = TRAIN_CHARS) -> Network:
    own = labels.where(keep)
    n = {r["toxic"]: r["n"] for r in own.where("toxic IS NOT NULL").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [training_sample(docs, own, "toxic", F.col("toxic") == k, rows, chars) for k, rows in ((1, toxic_rows), (0, clean_rows))]
    return fit([t for p in parts for t in p[0]], np.concatenate([p[1] for p in parts]), n.get(1, 0) / max(1, sum(n.values())))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole document; labels with remainder 0 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = score_column(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
