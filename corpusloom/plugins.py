"""Extension points: normalisers, rewards, metrics, losses, templates and loss scales by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import messages as M
from corpusloom.functions import rewards as R
from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import normalise as N
from corpusloom.operators.mappers import MAPPERS

#: name -> DataFrame to DataFrame (a row may become none or many).
NORMALISERS: dict[str, Callable[..., DataFrame]] = {"auto": N.auto, "messages": N.conversations, "alpaca": N.alpaca, "response": N.responses, "cls": N.classification, **MAPPERS}
#: name -> expression of completion (and solution).
REWARDS: dict[str, Callable[..., Column]] = {
    "format": R.format_reward, "react_format": R.react_format, "cosine": R.cosine_length, "repetition": R.repetition, "soft_overlong": R.soft_overlong, "accuracy": lambda c, s: R.vectorised(R.math_accuracy)(c, s),
    "countdown": lambda c, s: R.vectorised(R.countdown)(c, s), "string": R.string_accuracy, "code_format": R.code_format, "tool_format": R.tool_format, "tool_length": R.tool_length, "tool_match": lambda c, s: R.vectorised(R.tool_match)(c, s), "toolbench": R.react_score,
}
#: name -> DataFrame to one row (or a row a group).
METRICS: dict[str, Callable[..., DataFrame]] = {"mean": A.mean_metric, "acc": A.token_accuracy, "paired": A.pair_correlations, "reranker": A.rank_metrics}
LOSSES: dict[str, Callable[..., DataFrame]] = {"pointwise_reranker": A.pointwise_loss, "listwise_reranker": A.listwise_loss}
LOSS_SCALES: dict[str, Callable[..., Column]] = {s: (lambda m, s=s: M.loss_scales(m, s)) for s in ("default", "last_round", "all")}
TEMPLATES: dict[str, Callable[..., Column]] = {"chatml": M.render, "empty": lambda m: F.array_join(F.transform(m, lambda x: x["content"]), "")}
TOOL_FORMATS = (*T.TOOL_FORMATS, "hermes")


def register(table: dict, name: str, f: Callable, exist_ok: bool = False) -> Callable:
    if name in table and not exist_ok:
        raise ValueError(f"{name} is registered")
    table[name] = f
    return f


def load_plugins(spark: SparkSession, *paths: str) -> None:
    """Python files that register what they define, run here and shipped to the executors."""
    import runpy

    for path in paths:
        spark.sparkContext.addPyFile(path)
        runpy.run_path(path)


def map_rows(df: DataFrame, f: Callable[[dict], dict | list[dict] | None], schema: str) -> DataFrame:
    """The escape hatch: a Python function of a row to none, one or many rows, in Arrow batches."""
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                got = f(row)
                out += got if isinstance(got, list) else [got] if got is not None else []
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)
