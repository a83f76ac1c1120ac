"""Order of all suffixes and their common prefixes by induced sorting in external memory.

A text is an array of symbols in which 0 ends each string (and begins the text); no common prefix reaches past an end.
Suffixes are of type S if smaller than their successor, else L; those of type S behind one of type L are marked.
Each level first sorts the marked substrings, by inducing from marked places ordered by their first run, and names
them; if names repeat, the string of names is sorted by recursion. From the marked suffixes all of type L are induced in
ascending order, and from these all of type S in descending order. Both passes take tuples (symbol, place, common prefix
with the tuple before) from a priority queue and put those of the preceding places into it. The common prefix of two
neighbours in a bucket is one more than the least between the suffixes that induced them; where the types
meet in a bucket, it is the shorter of two runs; from names to symbols it is a distance and a least value among names.

Memory: a queue holds a bounded number of tuples; beyond, sorted runs go to disk and are merged as they are
read. Texts and results beyond IN_MEMORY bytes lie in unlinked files in the folder where Spark itself spills
(SPARK_LOCAL_DIRS), mapped as arrays; nothing is left behind, and nobody else reads them. Passes work on batches, a
symbol or a range of symbols at a time: what a batch puts into its own range is taken before what comes after it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Most rows of a batch; bytes of an array that stays in memory.
BATCH, IN_MEMORY = 1 << 17, 1 << 25
#: Least and most tuples that a queue holds in memory.
HELD = (1 << 14, 1 << 20)
#: Strings of names that end the recursion: so many symbols at most, none longer than that. They are sorted in memory.
BASE, BASE_LENGTH = 1 << 22, 1 << 12
_FAR = np.iinfo(np.int32).max


def store(n: int, kind: type, limit: int | None = None) -> np.ndarray:
    """An array of zeros; a large one lies in an unlinked file."""
    size = int(n) * np.dtype(kind).itemsize
    if size <= (IN_MEMORY if limit is None else limit):
        return np.zeros(n, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as f:
        f.truncate(size)
        return np.asarray(np.memmap(f, kind, "r+", shape=(int(n),)))


class Queue:
    """A priority queue of tuples (symbol, place, common prefix), in order of symbol and then of arrival."""

    def __init__(self, expected: int, held: int | None = None) -> None:
        self.size = held or int(np.clip(expected // 16, *HELD))
        self.held, self.fill = np.empty((3, self.size), np.int64), 0
        self.runs: list[list] = []

    def push(self, *columns: np.ndarray) -> None:
        at, n = 0, len(columns[0])
        while at < n:
            m = min(n - at, self.size - self.fill)
            for row, column in zip(self.held, columns, strict=True):
                row[self.fill : self.fill + m] = column[at : at + m]
            at, self.fill = at + m, self.fill + m
            if self.fill == self.size:
                self._spill()

    def _spill(self) -> None:
        """A sorted run of what is held, on disk if it is large."""
        rows = self.held[:, : self.fill]
        rows = rows[:, rows[0] >= 0]  # what was taken is marked
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        run = [store(rows.shape[1], np.int64) for _ in rows]
        for a, b in zip(run, rows, strict=True):
            a[:] = b
        self.runs.append([run, 0])
        self.fill = 0

    def pop(self, below: int, most: int | None = None) -> np.ndarray:
        """All tuples with symbols below; at most `most` of them, the first to have come, if they share a symbol."""
        parts, left = [], _FAR if most is None else most
        for entry in self.runs:
            run, at = entry
            end = min(at + int(np.searchsorted(run[0][at:], below)), at + left)
            if end > at:
                parts.append(np.stack([x[at:end] for x in run]))
                left -= end - at
                entry[1] = end
        self.runs = [x for x in self.runs if x[1] < len(x[0][0])]
        symbols = self.held[0, : self.fill]
        found = np.flatnonzero((symbols < below) & (symbols >= 0))[: max(left, 0)]
        if len(found):
            parts.append(self.held[:, found])
            self.held[0, found] = -1
        if not parts:
            return np.zeros((3, 0), np.int64)
        rows = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
        return rows if most is not None else rows[:, np.argsort(rows[0], kind="stable")]


class Least:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, before = 1 << (len(self.levels) - 1), self.levels[-1]
            made = store(len(before) - half, np.int32)
            np.minimum(before[:-half], before[half:], out=made)
            self.levels.append(made)

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from low to high, both included."""
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k) + 1])
        return out


def run_lengths(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the symbol at each place stands there in a row."""
    out = np.ones(len(at), np.int64)
    alive, k = np.flatnonzero(text[at] != 0), 0
    while len(alive):
        k += 1
        alive = alive[text[at[alive] + k] == text[at[alive]]]
        out[alive] += 1
    return out


def induce(text: np.ndarray, alphabet: int, counts: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], flip: bool, sink: Callable, held: int | None = None) -> None:
    """One pass. counts: suffixes to induce, by symbol; seeds: (places, common prefix with the seed before) in order.

    flip: descending, as the ascending pass of the complemented symbols. sink gets (places, common prefix with the
    place before, whether it is a seed) of all suffixes of the pass, seeds included, in order.
    """
    turn = (lambda s: np.where(s > 0, alphabet + 1 - s, 0)) if flip else (lambda s: s)
    by_seed = np.zeros(alphabet + 2, np.int64)
    for a in range(0, len(seeds[0]), BATCH):
        by_seed += np.bincount(turn(text[seeds[0][a : a + BATCH]].astype(np.int64)), minlength=alphabet + 2)
    induced = np.concatenate([counts[:1], counts[:0:-1], [0]]) if flip else np.append(counts, 0)
    ends = np.cumsum(by_seed + induced)
    seed_ends = np.cumsum(by_seed)
    total = int(ends[-1])
    step = int(np.clip((2 * total) ** 0.5, 1 << 10, BATCH))
    queue = Queue(total, held)
    last, tail = store(alphabet + 2, np.int32), store(alphabet + 2, np.int32)
    last[:] = -1
    least, batch = np.full(64, _FAR, np.int32), 0  # least[k]: of all batches from k on
    before = (-1, True, 0)  # symbol, whether it is a seed, place

    def settle(symbol: np.ndarray, place: np.ndarray, common: np.ndarray, seed: np.ndarray, ahead: np.ndarray) -> None:
        """Puts out a batch whose order is final and puts its predecessors into the queue. ahead: their symbols."""
        nonlocal least, batch, before
        n = len(symbol)
        same = np.empty(n, bool)
        same[0] = symbol[0] == before[0]
        same[1:] = symbol[1:] == symbol[:-1]
        a = np.where(same, common, 0).astype(np.int32)
        meets = seed & same
        meets[0] &= not before[1]
        meets[1:] &= ~seed[:-1]
        meets = np.flatnonzero(meets)
        if len(meets):
            other = np.where(meets > 0, place[meets - 1], before[2])
            a[meets] = np.minimum(run_lengths(text, other), run_lengths(text, place[meets]))
        before = (int(symbol[-1]), bool(seed[-1]), int(place[-1]))
        sink(place, a, seed)
        j = np.flatnonzero((ahead > symbol) | ((ahead == symbol) & ~seed))
        lowest = np.minimum.accumulate(a)
        if len(j):
            target = ahead[j]
            order = np.argsort(target, kind="stable")
            j, target = j[order], target[order]
            new = np.concatenate([[True], target[1:] != target[:-1]])
            shared = np.empty(len(j), np.int64)
            k = np.flatnonzero(~new)
            if len(k):
                shared[k] = 1 + Least(a).between(j[k - 1] + 1, j[k])
            k = np.flatnonzero(new)
            of, since = target[k], last[target[k]]
            m = np.minimum(np.minimum(tail[of], lowest[j[k]]), least[since + 1])
            shared[k] = np.where(since < 0, 0, 1 + m.astype(np.int64))
            k = np.append(k[1:], len(j)) - 1  # the last of each symbol
            rest = np.append(np.minimum.accumulate(a[::-1])[::-1], _FAR)
            tail[target[k]], last[target[k]] = rest[j[k] + 1], batch
            queue.push(target, place[j] - 1, shared)
        np.minimum(least[: batch + 1], lowest[-1], out=least[: batch + 1])
        batch += 1
        if batch == len(least):
            least = np.concatenate([least, np.full(batch, _FAR, np.int32)])

    def ahead_of(place: np.ndarray) -> np.ndarray:
        s = text[place - 1].astype(np.int64)
        return np.where(s > 0, turn(s), -1)

    def seeds_from(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = seeds[0][a:b].astype(np.int64)
        return turn(text[place].astype(np.int64)), place, seeds[1][a:b].astype(np.int64)

    low, seed_at = 0, 0
    while low <= alphabet:
        start = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, start + step, "right")))
        if int(ends[min(high, alphabet + 1) - 1]) == start:
            low = high
            continue
        seed_end = int(seed_ends[min(high, alphabet + 1) - 1])
        if high == low + 1:  # one symbol: those induced come as they were put in, then the seeds
            while (rows := queue.pop(high, BATCH)).shape[1]:
                settle(rows[0], rows[1], rows[2], np.zeros(rows.shape[1], bool), ahead_of(rows[1]))
            for a in range(seed_at, seed_end, BATCH):
                rows = seeds_from(a, min(a + BATCH, seed_end))
                settle(*rows, np.ones(len(rows[0]), bool), ahead_of(rows[1]))
        else:
            rows = np.concatenate([queue.pop(high), np.stack(seeds_from(seed_at, seed_end))], axis=1)
            seed = np.arange(rows.shape[1]) >= rows.shape[1] - (seed_end - seed_at)
            while rows.shape[1]:
                order = np.argsort(rows[0] * 2 + seed, kind="stable")
                rows, seed = rows[:, order], seed[order]
                ahead = ahead_of(rows[1])
                inside = (ahead < high) & ((ahead > rows[0]) | ((ahead == rows[0]) & ~seed))
                n = rows.shape[1]
                if inside.any():  # what comes before the first symbol that gets more is final
                    first = int(ahead[inside].min())
                    n = int(np.searchsorted(rows[0], first)) or int(np.searchsorted(rows[0] * 2 + seed, 2 * first + 1))
                settle(rows[0, :n], rows[1, :n], rows[2, :n], seed[:n], ahead[:n])
                if n == rows.shape[1] and not inside.any():
                    break
                more = queue.pop(high)
                rows, seed = np.concatenate([rows[:, n:], more], axis=1), np.concatenate([seed[n:], np.zeros(more.shape[1], bool)])
        low, seed_at = high, seed_end


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, BATCH * 4):
        yield a, min(n, a + BATCH * 4)


def classify(text: np.ndarray) -> np.ndarray:
    """1 for places of type L, 0 for type S; 2 for type S behind type L, 3 for ends."""
    n = len(text)
    kind = store(n, np.uint8)
    carry = 0
    for a, b in reversed(list(_blocks(n))):
        here, after = text[a:b], np.append(text[a + 1 : b], text[b] if b < n else 0)
        differs = np.flatnonzero(here != after)
        larger = (here > after)[differs]
        at = np.searchsorted(differs, np.arange(b - a))  # the next place whose successor differs
        kind[a:b] = np.append(larger, bool(carry))[at]
        kind[a:b][here == 0] = 0
        carry = kind[a] if here[0] else 0
    for a, b in reversed(list(_blocks(n))):
        left = np.concatenate([kind[a - 1 : a] if a else [0], kind[a : b - 1]])
        kind[a:b][(kind[a:b] == 0) & (left == 1) & (text[a:b] > 0)] = 2
        kind[a:b][text[a:b] == 0] = 3
    return kind


def sort_in_memory(text: np.ndarray, sink: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """What suffix_order gives, by doubling, for a text that fits in memory."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    places = np.flatnonzero(text)
    if not len(places):
        return
    left = ends[np.searchsorted(ends, places)] - places  # symbols to the end
    rank = text.astype(np.int64)
    length = 1
    while True:
        after = np.where(left > length, rank[np.minimum(places + length, n - 1)], 0)
        key = (rank[places] << 32) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[places[order]] = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
        length *= 2
        if length >= left.max() or (key[1:] != key[:-1]).all():
            break
    del key, after, rank
    places = places[order][::-1]
    for a in range(0, len(places), BATCH):
        p = places[a : a + BATCH]
        q = places[max(a - 1, 0) : a + len(p) - 1] if a else np.concatenate([p[:1], p[:-1]])
        common = np.zeros(len(p), np.int32)
        alive = np.arange(len(p)) if a else np.arange(1, len(p))
        while len(alive):
            k = common[alive]
            x = text[p[alive] + k]
            alive = alive[(x == text[q[alive] + k]) & (x > 0)]
            common[alive] += 1
        sink(p, common)


def suffix_order(text: np.ndarray, alphabet: int, sink: Callable[[np.ndarray, np.ndarray], None], held: int | None = None, base: int = BASE) -> None:
    """Gives the places of all suffixes but the ends in descending order, in batches with the common prefix of each with the one before.

    text: symbols up to `alphabet`, 0 at the beginning and after each string. held: tuples that a queue holds; base: symbols
    of a string of names that is sorted in memory.
    """
    n = len(text)
    kind = classify(text)
    large, small = np.zeros(alphabet + 1, np.int64), np.zeros(alphabet + 1, np.int64)
    marks, ends, stars = [], [], 0
    for a, b in _blocks(n):
        large += np.bincount(text[a:b][kind[a:b] == 1], minlength=alphabet + 1)
        small += np.bincount(text[a:b][(kind[a:b] == 0) | (kind[a:b] == 2)], minlength=alphabet + 1)
        marks.append(np.flatnonzero(kind[a:b] >= 2) + a)
        ends.append(np.flatnonzero(kind[a:b] == 3) + a)
    where, ends = _stored(marks), _stored(ends)[1:]  # where: marked places and ends, the first end included

    def both(seeds: tuple[np.ndarray, np.ndarray], out: Callable) -> None:
        """Both passes from marked suffixes in ascending order."""
        total = int(large.sum())
        place, common, fill = store(total, np.int64), store(total, np.int32), 0

        def keep(p: np.ndarray, a: np.ndarray, seed: np.ndarray) -> None:
            nonlocal fill
            m = int((~seed).sum())
            # Descending: what was common with the place before becomes common with the place after.
            place[total - fill - m : total - fill] = p[~seed][::-1]
            common[total - fill - m : total - fill] = a[~seed][::-1]
            fill += m

        induce(text, alphabet, large, seeds, False, keep, held)
        if total:
            for a, b in reversed(list(_blocks(total))):
                common[a + 1 : b] = common[a : b - 1].copy()
                common[a] = common[a - 1] if a else 0
        induce(text, alphabet, small, (place, common), True, lambda p, a, seed: out(p, a), held)

    starred = np.flatnonzero(text[where] > 0)
    stars = len(starred)
    n_ends = len(ends)
    seed_place, seed_common = store(n_ends + stars, np.int64), store(n_ends + stars, np.int32)
    seed_place[:n_ends] = ends
    if stars:
        own = where[starred]
        runs = run_lengths(text, own)
        order = np.argsort((text[own].astype(np.int64) << 32) + ((1 << 32) - 1 - runs), kind="stable")
        seed_place[n_ends:] = own[order]
        again = np.minimum(runs[order][1:], runs[order][:-1])
        seed_common[n_ends + 1 :] = np.where(text[own[order][1:]] == text[own[order][:-1]], again, 0)
        seed_common[1:n_ends] = 1
        # A marked substring ends with the run at the next marked place, or with the end of its string.
        reach = store(n, np.int32)
        next_run = np.ones(len(where), np.int64)
        next_run[starred] = runs
        reach[own] = where[starred + 1] - own + next_run[starred + 1]
        found, shared, fill, carry = store(stars, np.int64), store(stars, np.int32), 0, _FAR

        def marked(p: np.ndarray, a: np.ndarray) -> None:
            nonlocal fill, carry
            at = np.flatnonzero(kind[p] == 2)
            if not len(at):
                carry = min(carry, int(a.min()))
                return
            m = np.minimum.reduceat(a[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))  # from each to the next
            m[0] = min(int(m[0]), carry)
            found[fill : fill + len(at)], shared[fill : fill + len(at)] = p[at], m
            fill += len(at)
            carry = int(a[at[-1] + 1 :].min()) if at[-1] + 1 < len(a) else _FAR

        both((seed_place, seed_common), marked)
        shared[0] = 0
        found, shared = found[::-1], np.append(shared[:0:-1], 0)  # ascending; shared with the next
        shared = np.concatenate([[0], shared[:-1]]).astype(np.int32)
        size = reach[found]
        alike = (shared[1:] == size[1:]) & (shared[1:] == size[:-1])
        name = np.concatenate([[1], 1 + np.cumsum(~alike)])
        if int(name[-1]) < stars:
            names = store(len(where), np.int64)
            names[np.searchsorted(where, found)] = name
            nearest = np.zeros(int(name[-1]) + 1, np.int32)
            nearest[name[1:][~alike]] = shared[1:][~alike]
            least = Least(nearest)
            fill, previous = stars, None

            def renamed(p: np.ndarray, ell: np.ndarray) -> None:
                """Descending names to ascending marked places; the common prefix goes to the larger neighbour."""
                nonlocal fill, previous
                other = np.concatenate([p[:1] if previous is None else [previous], p[:-1]])
                x, y = p + ell, other + ell
                one, two = np.minimum(names[x], names[y]), np.maximum(names[x], names[y])
                chars = where[x] - where[p]
                more = np.flatnonzero(one < two)
                chars[more] += least.between(one[more] + 1, two[more])
                seed_place[n_ends + fill - len(p) : n_ends + fill] = where[p][::-1]
                upper = slice(n_ends + fill - len(p) + 1, min(n_ends + fill, n_ends + stars - 1) + 1)
                values = chars[::-1] if previous is not None else chars[:0:-1]
                seed_common[upper] = values
                fill -= len(p)
                previous = int(p[-1])

            gaps = np.diff(np.flatnonzero(names == 0))
            if len(names) <= base and gaps.max() <= BASE_LENGTH:
                sort_in_memory(names, renamed)
            else:
                suffix_order(names, int(name[-1]), renamed, held, base)
        else:
            seed_place[n_ends:], seed_common[n_ends:] = found, shared
        seed_common[n_ends] = 0
        seed_common[:n_ends] = 0
    both((seed_place, seed_common), sink)


def _stored(parts: list[np.ndarray]) -> np.ndarray:
    out, at = store(sum(map(len, parts)), np.int64), 0
    for x in parts:
        out[at : at + len(x)] = x
        at += len(x)
    return out


class Growing:
    """An array that grows at its end; from IN_MEMORY bytes on it lies in an unlinked file."""

    def __init__(self, kind: type) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.kind, self.size = np.dtype(kind), 0
        self.file = tempfile.SpooledTemporaryFile(IN_MEMORY, dir=folder if os.path.isdir(folder) else None)

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.size += len(values)

    def array(self) -> np.ndarray:
        if not self.size:
            return np.zeros(0, self.kind)
        if not getattr(self.file, "_rolled", True):
            self.file.seek(0)
            return np.frombuffer(self.file.read(), self.kind)
        self.file.flush()
        return np.asarray(np.memmap(self.file, self.kind, "r", shape=(self.size,)))
