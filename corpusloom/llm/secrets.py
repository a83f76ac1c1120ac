"""Secret scans with multipart credential linking.

Strong patterns (assign, access, hex) are reported wherever they stand. Weak candidates mean nothing on
their own and are reported only where complementary parts co-occur. Parts are half-open intervals of
code points in a scope, the text between two blank lines, so that one config block does not lend its parts
to another. Tables of parts are joined on document and scope, by intervals that do not overlap (parts of the
same characters do not complement each other):

* identifier: a user, account or client id; reported with a secret part in its scope;
* secret: a long token of mixed classes; reported with an access key or identifier in its scope;
* endpoint: a URL host or host:port; reported with both an access part and a secret part in its scope.

Secret parts are assign, hex and secret spans, access parts are access and identifier spans. Only existence is
asked, so an interval looks up the next start and the last end of the other side in sorted order (no further away
than `reach`, if it is given): the join costs n log n in the parts and makes no pairs. A scope lies in one document,
so the tables of a batch of documents are joined where they are read, without a shuffle. All patterns are linear in
the text.

Cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows each get
a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the maximal runs of AKIA[A-Z0-9]+ with 20+ characters
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ with 24+ characters
ASSIGN_LEAST = 6
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client[_-]?id|key[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9.-])(?:[a-z][a-z0-9+.-]{1,12}://[A-Za-z0-9.-]+(?::\d{1,5})?|[a-z0-9][a-z0-9.-]*+:\d{2,5})")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Code points between parts that may belong together, for callers that want less than the scope.
REACH = 300
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each strong kind; matches that are too short are dropped after matching."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _mixed(word: str) -> bool:
    """Looks like key material: upper, lower and digits, over 3.5 bits a character."""
    if not (re.search("[a-z]", word) and re.search("[A-Z]", word) and re.search("[0-9]", word)):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in (word.count(x) for x in set(word))) > 3.5


class Parts:
    """A table of parts: document, scope, kind, start and end."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str, int, int]] = []

    def add(self, document: int, edges: list[int], spans: list[Span]) -> None:
        self.rows += [(document, bisect_right(edges, a), kind, a, b) for kind, a, b in spans]

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scope of a document as one number, start, end)."""
        t = np.array([(d << 32 | s, a, b) for d, s, _, a, b in self.rows], np.int64).reshape(-1, 3)
        return t[:, 0], t[:, 1], t[:, 2]


def interval_join(left: Parts, right: Parts, reach: int | None = None) -> np.ndarray:
    """Whether each row of the left table has one of the right in its scope that it does not overlap, at most `reach` away."""
    if not left.rows or not right.rows:
        return np.zeros(len(left.rows), bool)
    scope, start, end = right.columns()
    known = np.unique(scope)
    place = lambda at, x: (at << 40) + x  # noqa: E731  scopes in order, positions within
    at = np.searchsorted(known, scope)
    starts, ends = np.sort(place(at, start)), np.sort(place(at, end))
    scope, start, end = left.columns()
    at = np.minimum(np.searchsorted(known, scope), len(known) - 1)
    far = (1 << 39) if reach is None else reach
    k = np.searchsorted(starts, place(at, end))  # the first that starts at the end or after it
    after = (k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] < np.minimum(place(at, end) + far, place(at + 1, 0)))
    k = np.searchsorted(ends, place(at, start), "right") - 1  # the last that ends at the start or before it
    before = (k >= 0) & (ends[k] > np.maximum(place(at, start) - far, place(at, 0)))
    return (known[at] == scope) & (after | before)


def _is_host(found: str) -> bool:
    """A match with a scheme, or labels of letters, digits and hyphens before a port: two or more, up to 63 characters each."""
    if "://" in found:
        return True
    labels = found.rpartition(":")[0].split(".")
    return len(labels) > 1 and all(x and x[0] != "-" and len(x) < 64 for x in labels)


def weak_spans(text: str, base: list[Span]) -> tuple[list[Span], list[Span], list[Span]]:
    """Candidates (identifiers, secrets, endpoints) of a text; identifiers and secrets only outside strong spans."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))

    def free(m: re.Match) -> bool:
        k = bisect_left(starts, m.end())
        return not k or ends[k - 1] <= m.start()

    identifiers = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text) if free(m)]
    if not identifiers and not any(k == "access" for k, _, _ in base):
        return [], [], []  # nothing that a secret or an endpoint could go with
    secrets = [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if free(m) and _mixed(m.group())]
    return identifiers, secrets, [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text) if _is_host(m.group())]


def linked(texts: list[str], bases: list[list[Span]], reach: int | None = None) -> list[list[Span]]:
    """The weak candidates of each text that complementary parts support."""
    access, keys, weak = Parts(), Parts(), [Parts(), Parts(), Parts()]
    for d, (text, base) in enumerate(zip(texts, bases, strict=True)):
        found = weak_spans(text, base)
        if any(found):
            edges = [m.end() for m in BLANK_LINE.finditer(text)]
            access.add(d, edges, [s for s in base if s[0] == "access"] + found[0])
            keys.add(d, edges, [s for s in base if s[0] != "access"] + found[1])
            for parts, spans in zip(weak, found, strict=True):
                parts.add(d, edges, spans)
    identifiers, secrets, endpoints = weak
    kept = (interval_join(identifiers, keys, reach), interval_join(secrets, access, reach), interval_join(endpoints, access, reach) & interval_join(endpoints, keys, reach))
    out: list[list[Span]] = [[] for _ in texts]
    for parts, ok in zip(weak, kept, strict=True):
        for (d, _, kind, a, b), yes in zip(parts.rows, ok.tolist(), strict=True):
            if yes:
                out[d].append((kind, a, b))
    return out


def linked_spans(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak candidates of one text whose complementary parts are in the same scope, and within reach unless it is None."""
    return linked([text], [base], reach)[0]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


SPANS_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def secret_spans(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """One row per document: counts of the strong kinds, the digest of their spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            for base, more in zip(bases, linked(texts, bases, reach), strict=True):
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scan, SPANS_SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return secret_spans(table(spark, sf_dir, "documents"))
