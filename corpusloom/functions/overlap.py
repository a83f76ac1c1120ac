"""Text overlap scores: ROUGE-1, ROUGE-2 by expressions; ROUGE-L and BLEU-4 need dynamic programming and counts, so they
are Arrow UDFs on numbered words. Tokens come from any tokenizer as arrays."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bound
from corpusloom.operators.aggregates import gram_hashes, hashed_words


def rouge_n(predicted: Column, reference: Column, n: int) -> Column:
    """F of distinct n-gram overlap (64-bit hashes); 0 if either side has none."""
    grams = lambda w: bound(hashed_words(w), lambda h: F.array_distinct(gram_hashes(h, n)))
    score = lambda a, b: F.try_divide(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))
    return F.coalesce(bound(F.struct(grams(predicted).alias("a"), grams(reference).alias("b")), lambda g: score(g["a"], g["b"])), F.lit(0.0))


#: Words of a whose rows are the bits of one number.
LCS_BITS = 4096


def lcs(a: list | np.ndarray, b: list | np.ndarray, width: int = LCS_BITS) -> int:
    """Length of the longest common subsequence: common ends belong to it; between them `width` rows at a time as bits (clear where
    the length grows), carries between them."""
    a, b = (x if isinstance(x, np.ndarray) else np.array(x, object) for x in (a, b))
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :] != b[len(b) - short :])
    tail = short - 1 - int(differ[-1]) if len(differ) else short
    differ = np.flatnonzero(a[: short - tail] != b[: short - tail])
    head = int(differ[0]) if len(differ) else short - tail
    a, b = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    n, carries = head + tail, bytearray(len(b))
    for at in range(0, len(a) if b else 0, width):
        block = a[at : at + width]
        places: dict = {}
        for k, x in enumerate(block):
            places[x] = places.get(x, 0) | 1 << k
        full = left = (1 << len(block)) - 1
        for j, y in enumerate(b):
            grows = left & places.get(y, 0)
            total = left + grows + carries[j]
            carries[j] = total >> len(block)
            left = (total | left - grows) & full
        n += len(block) - left.bit_count()
    return n


def rouge_l_score(a: list | np.ndarray, b: list | np.ndarray) -> float:
    n = lcs(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def _bleu4(hits: list[int], predicted: int, reference: int) -> float:
    """From the matches of each order and the lengths."""
    if not hits[0]:
        return 0.0
    logs, missed = 0.0, 0
    for n, hit in enumerate(hits):
        missed += not hit
        logs += math.log((hit or 0.5**missed) / max(1, predicted - n)) / 4
    return min(1.0, math.exp(1 - reference / predicted)) * math.exp(logs)


def bleu4_score(predicted: list, reference: list) -> float:
    """BLEU-4 with geometric smoothing: the k-th order without a match counts 1 / 2^k matches; 0 without any common word."""
    grams = lambda w, n: Counter(zip(*(w[i:] for i in range(n)), strict=False))
    return _bleu4([sum((grams(predicted, n) & grams(reference, n)).values()) for n in range(1, 5)], len(predicted), len(reference))


#: Words of both sides that are counted at once: few enough for the tables of runs to stay in a core's cache.
COUNT_WORDS = 1 << 16


def _numbered(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows in parts of about COUNT_WORDS words: (words as numbers, their rows) of a, then of b, and the lengths of both; a null is empty."""
    size = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    ends = [np.concatenate([[0], np.cumsum(n)]) for n in size]
    total, low = ends[0] + ends[1], 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(total, total[low] + COUNT_WORDS, "right")) - 1)
        flat = pa.concat_arrays([a[low:high].flatten(), b[low:high].flatten()])
        ids = flat.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        na, nb = size[0][low:high], size[1][low:high]
        row, cut = np.arange(high - low), int(na.sum())
        yield ids[:cut], np.repeat(row, na), ids[cut:], np.repeat(row, nb), na, nb
        low = high


def _hits(ids_a: np.ndarray, row_a: np.ndarray, ids_b: np.ndarray, row_b: np.ndarray, rows: int) -> list[np.ndarray]:
    """Clipped matches of each row for runs of 1 to 4 words. A run is numbered by the run without its last word and that word, so numbers are exact."""
    words, out = 1 + max(ids_a.max(initial=0), ids_b.max(initial=0)), []
    grams = [row_a, row_b]
    for n in range(4):
        keys = []
        for k, (ids, row) in enumerate(((ids_a, row_a), (ids_b, row_b))):
            whole = row[n:] == row[: len(row) - n]  # the run stays in its row
            key = grams[k][: len(whole)] * words + ids[n:]
            key[~whole] = -1
            keys.append(key)
        cut = len(keys[0])
        codes, runs = pd.factorize(np.concatenate(keys))
        grams = [codes[:cut], codes[cut:]]
        owner = np.zeros(len(runs), np.int64)
        owner[grams[0]] = row_a[:cut]
        clipped = np.minimum(*(np.bincount(g, minlength=len(runs)) for g in grams))
        clipped[runs < 0] = 0
        out.append(np.bincount(owner, clipped, rows).astype(np.int64))
    return out


def _rouge_l_scores(ids_a: np.ndarray, _a: np.ndarray, ids_b: np.ndarray, _b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[float]:
    ends = zip(np.cumsum(na).tolist(), np.cumsum(nb).tolist(), na.tolist(), nb.tolist(), strict=True)
    return [rouge_l_score(ids_a[x - n : x], ids_b[y - m : y]) for x, y, n, m in ends]


def _bleu4_scores(ids_a: np.ndarray, row_a: np.ndarray, ids_b: np.ndarray, row_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[float]:
    hits = np.stack(_hits(ids_a, row_a, ids_b, row_b, len(na)), 1)
    return [_bleu4(h, n, m) for h, n, m in zip(hits.tolist(), na.tolist(), nb.tolist(), strict=True)]


_SCORES = {"rouge_l": _rouge_l_scores, "bleu_4": _bleu4_scores}


def scores(predicted: Column, reference: Column, names: tuple[str, ...] = tuple(_SCORES)) -> Column:
    """A struct of the named scores, so that words are numbered once for all of them; a score is null where either side is."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found: dict[str, list[float]] = {n: [] for n in names}
        for part in _numbered(a, b):
            for n in names:
                found[n] += _SCORES[n](*part)
        absent = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(found[n], pa.float64(), mask=absent) for n in names], list(names))

    return F.arrow_udf(run, ", ".join(f"{n} double" for n in names))(predicted, reference)


def rouge_l(predicted: Column, reference: Column) -> Column:
    return scores(predicted, reference, ("rouge_l",))["rouge_l"]


def bleu4(predicted: Column, reference: Column) -> Column:
    return scores(predicted, reference, ("bleu_4",))["bleu_4"]
