"""Datasets by reference, registry and plug-in, over folders that Spark writes from the driver's tables."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.operators.sampling import calibration_windows
from corpusloom.plans.loader import load_dataset
from corpusloom.plans.registry import query
from corpusloom.session import scratch_dir, table
from corpusloom.sources.refs import DatasetRef, Registry

_REF = "[source, 'hf::' || source, 'MS::org/' || source, source || '#' || doc_id, 'hf::' || source || ':' || lang, source || ':' || lang || '/x#' || doc_id, 'other::' || source || ':a/b/' || lang][doc_id % 7 + 1]"


def _reference(row: dict) -> dict:
    ref = DatasetRef.parse(row["ref"], exists=lambda _: False)
    return {"doc_id": row["doc_id"], "hub": ref.hub, "dataset": ref.dataset, "subsets": "|".join(ref.subsets), "sample": ref.sample, "again": DatasetRef.parse(ref.format(), exists=lambda _: False) == ref}


@query("src01_references", f"""WITH r AS (SELECT doc_id, {_REF} AS ref FROM documents), a AS (SELECT *, CASE WHEN contains(ref, '::') THEN lower(split_part(ref, '::', 1)) END AS h, CASE WHEN contains(ref, '::') THEN split_part(ref, '::', 2) ELSE ref END AS rest FROM r),
 b AS (SELECT *, split_part(rest, '#', 1) AS body, nullif(split_part(rest, '#', 2), '')::BIGINT AS sample FROM a)
 SELECT doc_id, CASE WHEN h IN ('hf', 'ms') THEN h END AS hub, split_part(body, ':', 1) AS dataset, replace(split_part(body, ':', 2), '/', '|') AS subsets, sample, true AS again FROM b""")
def _(s, d):
    """References of seven forms, parsed, formatted and parsed again."""
    c, n = F.col("source"), F.col("doc_id").cast("string")
    forms = [c, F.concat(F.lit("hf::"), c), F.concat(F.lit("MS::org/"), c), F.concat(c, F.lit("#"), n), F.concat(F.lit("hf::"), c, F.lit(":"), "lang"), F.concat(c, F.lit(":"), "lang", F.lit("/x#"), n), F.concat(F.lit("other::"), c, F.lit(":a/b/"), "lang")]
    rows = table(s, d, "documents").select("doc_id", F.get(F.array(*forms), (F.col("doc_id") % 7).cast("int")).alias("ref"))
    return plugins.map_rows(rows, _reference, "doc_id long, hub string, dataset string, subsets string, sample long, again boolean")


def _folders(s: SparkSession, d: str) -> str:
    """A dataset folder with a subset for each language."""
    base = scratch_dir(s, "dataset")
    docs = table(s, d, "documents").select("doc_id", "lang", F.col("text").alias("body"))
    for lang in ("en", "de", "fr", "es"):
        docs.where(F.col("lang") == lang).drop("lang").write.parquet(f"{base}/{lang}/train.parquet")
    return base


def _registered(base: str) -> Registry:
    """Declared as JSON: two subsets by name, a weak one, and the column that holds the answer."""
    registry = Registry()
    subsets = ["en", {"name": "german", "subset": "de"}, {"name": "fr", "subset": "fr", "is_weak_subset": True}]
    registry.register_json(json.dumps([{"dataset_name": "docs", "dataset_path": base, "hf_dataset_id": "org/docs-of-all", "subsets": subsets, "columns": {"body": "response"}}]))
    return registry


def _answers(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5(F.get("messages", F.size("messages") - 1)["content"]).alias("answer"))


@query("src07_registered_subsets", "SELECT doc_id, md5(text) AS answer FROM documents WHERE lang IN ('en', 'de') AND text IS NOT NULL")
def _(s, d):
    """`all` takes the declared subsets that are not weak."""
    return _answers(load_dataset(s, "docs:all", registry=_registered(_folders(s, d)), remove_unused_columns=False)[0])


@query("src04_registry_lookup", "SELECT doc_id, md5(text) AS answer FROM documents WHERE lang IN ('de', 'fr') AND text IS NOT NULL UNION ALL SELECT doc_id, md5(text) FROM documents WHERE lang = 'es' AND text IS NOT NULL")
def _(s, d):
    """Subsets by name, the weak one asked for, and one that is not declared."""
    registry = _registered(_folders(s, d))
    return _answers(load_dataset(s, ["docs:german/fr", "docs:es"], registry=registry, remove_unused_columns=False)[0])


@query("src08_load_paths", "SELECT doc_id, md5(text) AS answer FROM documents WHERE lang IN ('en', 'es') AND text IS NOT NULL")
def _(s, d):
    """A folder and a file by their paths, concatenated."""
    base = _folders(s, d)
    base = base if "://" in base else "file://" + base  # what Spark writes as a file is a folder, so a URI names it
    return _answers(load_dataset(s, [f"{base}/en", f"{base}/es/train.parquet"], columns={"body": "response"}, remove_unused_columns=False)[0])


_WINDOW = "('0x' || substr(md5('7|' || doc_id), 1, 8))::BIGINT"


@query("src23_calibration_windows", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\f]+') AS w FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS k FROM t WHERE len(w) >= 128)
 SELECT doc_id, {_WINDOW} % (len(w) - 127) AS start, md5(array_to_string(w[{_WINDOW} % (len(w) - 127) + 1:{_WINDOW} % (len(w) - 127) + 128], ' ')) AS tokens FROM k WHERE k <= 64""")
def _(s, d):
    """64 sequences of 128 tokens for calibration, each from a place of its own in a document that is long enough."""
    from corpusloom.functions.text import words

    rows = table(s, d, "documents").select("doc_id", words(F.col("text")).alias("ids"))
    return calibration_windows(rows, "doc_id", "ids", 128, 64, 7).select("doc_id", "start", F.md5(F.array_join("ids", " ")).alias("tokens"))


_PLUGIN = """from corpusloom import plugins
from pyspark.sql import functions as F

plugins.register(plugins.REWARDS, "short", lambda c: F.greatest(1 - F.length(c) / 1000, F.lit(0.0)), exist_ok=True)
plugins.register(plugins.NORMALISERS, "no_questions", lambda df: df.where(~F.contains("text", F.lit("?"))), exist_ok=True)
plugins.register(plugins.METRICS, "spread", lambda df, c, by: df.groupBy(*by).agg((F.max(c) - F.min(c)).alias("value")), exist_ok=True)
plugins.register(plugins.TEMPLATES, "bars", lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "||"), exist_ok=True)
"""


def _plugged(s: SparkSession) -> None:
    """A file of plug-ins, as a user would name it, run here and shipped to the executors."""
    path = os.path.join(tempfile.mkdtemp(prefix="corpusloom-plugin-"), "corpusloom_example_plugin.py")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PLUGIN)
    plugins.load_plugins(s, path)


@query("udx09_plugin_file", "SELECT doc_id, round(greatest(1 - length(text) / 1000.0::DOUBLE, 0), 6) AS reward FROM documents WHERE NOT contains(text, '?')")
def _(s, d):
    """A reward and a normaliser from a file."""
    _plugged(s)
    docs = plugins.NORMALISERS["no_questions"](table(s, d, "documents"))
    return docs.select("doc_id", F.round(plugins.REWARDS["short"](F.col("text")), 6).alias("reward"))


@query("udx07_plugin_metric", "SELECT event_type, round(max(value) - min(value), 6) AS value FROM events GROUP BY event_type")
def _(s, d):
    """An aggregate from a file: its state is Spark's partial aggregation."""
    _plugged(s)
    return plugins.METRICS["spread"](table(s, d, "events"), "value", ["event_type"]).select("event_type", F.round("value", 6).alias("value"))


@query("udx08_plugin_template", "SELECT conv_id, md5(string_agg(role || '|' || text, '||' ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id")
def _(s, d):
    """Whole conversations by a template from a file."""
    _plugged(s)
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    messages = turns.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return messages.select("conv_id", F.md5(plugins.TEMPLATES["bars"](F.col("m"))).alias("rendered"))
