"""Dataset references and the registry: `hf::id_or_path:subset1/subset2#N`."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

HUBS = ("hf", "ms")
#: Paths in a store that Spark reads.
URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+://")
FILE = re.compile(r"\.(?:csv|json|jsonl|txt|parquet|orc)\Z", re.I)


def safe_split(s: str | None, sep: str, first: bool, right: bool = False) -> tuple[str | None, str | None]:
    """Two parts around a separator; a text without it is the first part or the second."""
    if not s:
        return None, None
    a, found, b = s.rpartition(sep) if right else s.partition(sep)
    if not found:
        return (s, None) if first else (None, s)
    return a, b


@dataclass(frozen=True)
class DatasetRef:
    dataset: str
    subsets: tuple[str, ...] = ()
    sample: int | None = None
    hub: str | None = None

    @classmethod
    def parse(cls, text: str, exists: Callable[[str], bool] = os.path.exists) -> DatasetRef:
        """An existing path wins over each separator in turn; a URI is a path, whose subsets are parted in its last part."""
        if URI.match(text):
            body, sample = safe_split(text, "#", True, right=True)
            scheme, _, rest = body.partition("://")
            store, slash, path = rest.partition("/")
            path, subsets = safe_split(path, ":", True)
            return cls(f"{scheme}://{store}{slash}{path or ''}", tuple(x.strip() for x in subsets.split("/")) if subsets else (), int(sample) if sample else None)
        hub, rest = (None, text) if exists(text) else safe_split(text, "::", False)
        body, sample = (rest, None) if exists(rest) else safe_split(rest, "#", True, right=True)
        name, subsets = (body, None) if exists(body) else safe_split(body, ":", True)
        hub = (hub or "").lower()
        return cls(name.strip(), tuple(x.strip() for x in subsets.split("/")) if subsets else (), int(sample) if sample else None, hub if hub in HUBS else None)

    def format(self) -> str:
        """The text that parses to this reference."""
        return f"{self.hub + '::' if self.hub else ''}{self.dataset}{':' + '/'.join(self.subsets) if self.subsets else ''}{f'#{self.sample}' if self.sample is not None else ''}"

    @property
    def is_file(self) -> bool:
        return bool(FILE.search(self.dataset)) if URI.match(self.dataset) else os.path.isfile(self.dataset)

    @property
    def is_folder(self) -> bool:
        return not FILE.search(self.dataset) if URI.match(self.dataset) else os.path.isdir(self.dataset)


@dataclass(frozen=True)
class Subset:
    name: str = "default"
    subset: str = "default"
    split: tuple[str, ...] = ()
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    weak: bool = False


@dataclass(frozen=True)
class DatasetMeta:
    name: str | None = None
    path: str | None = None
    hf_id: str | None = None
    ms_id: str | None = None
    subsets: tuple[Subset, ...] = (Subset(),)
    split: tuple[str, ...] = ("train",)
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    huge: bool = False

    def keys(self) -> list[tuple[str, str]]:
        kind = "repo" if self.path and DatasetRef(self.path).is_folder else "path"
        return [(k, v) for k, v in ((kind, self.path), ("ms", self.ms_id), ("hf", self.hf_id)) if v]


def short_name(name: str) -> str:
    """The last segment of an id or path; hub snapshots give the id's last part."""
    name = name.rstrip("/")
    snapshot = re.search(r"/datasets--.+?--(.+?)/snapshots/", name)
    return snapshot[1] if snapshot else name.rsplit("/", 1)[-1]


class Registry:
    def __init__(self) -> None:
        self.by_name: dict[str, DatasetMeta] = {}

    def register(self, meta: DatasetMeta, exist_ok: bool = False) -> DatasetMeta:
        name = meta.name or meta.ms_id or meta.hf_id or meta.path
        if not name:
            raise ValueError("a dataset needs a name, an id or a path")
        if name in self.by_name and not exist_ok:
            raise ValueError(f"{name} is registered")
        self.by_name[name] = meta
        return meta

    def lookup(self, ref: DatasetRef, default_hub: str = "ms") -> DatasetMeta:
        """By name, then by exact kind and id, then by short name; else defaults."""
        if ref.dataset in self.by_name:
            return self.by_name[ref.dataset]
        kind = "path" if ref.is_file else "repo" if ref.is_folder else ref.hub or default_hub
        exact = {k: m for m in self.by_name.values() for k in m.keys()}
        if (kind, ref.dataset) in exact:
            return exact[kind, ref.dataset]
        return {short_name(k[1]): m for k, m in exact.items()}.get(short_name(ref.dataset), DatasetMeta())

    def register_json(self, source: str | list[dict], base: str | None = None) -> list[DatasetMeta]:
        """Declared datasets: a JSON file, its text or its entries; relative paths start at the file's folder."""
        if isinstance(source, str):
            if os.path.isfile(source):
                base = base or os.path.dirname(os.path.abspath(source))
                with open(source, encoding="utf-8") as f:
                    source = json.load(f)
            else:
                source = json.loads(source)
        out = []
        for e in source:
            path = e.get("dataset_path")
            if path and base and not os.path.isabs(path) and not URI.match(path):
                path = os.path.join(base, path)
            subsets = tuple(Subset(s, s) if isinstance(s, str) else Subset(s.get("name", s.get("subset", "default")), s.get("subset", "default"), tuple(s.get("split", ())), layout(s), s.get("is_weak_subset", False)) for s in e.get("subsets", ["default"]))
            split = e.get("split", ["train"])
            out.append(self.register(DatasetMeta(e.get("dataset_name"), path, e.get("hf_dataset_id"), e.get("ms_dataset_id"), subsets, tuple([split] if isinstance(split, str) else split), layout(e), e.get("columns", {}), tuple(e.get("tags", ())), e.get("huge_dataset", False)), exist_ok=True))
        return out


def layout(entry: dict) -> Callable[[DataFrame], DataFrame] | None:
    """The normaliser that an entry's `columns` or `messages` asks for."""
    from corpusloom.operators import normalise as N

    columns, messages = entry.get("columns"), entry.get("messages")
    if messages is not None:
        return lambda df: N.conversations(df, columns, messages.get("role_key"), messages.get("content_key"), messages.get("inner_key"))
    return (lambda df: N.auto(df, columns)) if columns else None


def select_subsets(wanted: tuple[str, ...], meta: DatasetMeta) -> list[Subset]:
    """None asked for: the only one, or `default`; `all`: all that are not weak; unknown names pass through."""
    known = {s.name: s for s in meta.subsets}
    if not wanted:
        if len(known) > 1 and "default" not in known:
            raise ValueError(f"choose from the subsets {sorted(known)}")
        wanted = ("default",) if len(known) > 1 else tuple(known)
    elif wanted == ("all",) and "all" not in known:
        wanted = tuple(n for n, s in known.items() if not s.weak)
    picked = [known.get(n, Subset(n, n)) for n in wanted]
    return [replace(s, split=s.split or meta.split, preprocess=s.preprocess or meta.preprocess) for s in picked]
