"""Matching the units of one expert to those of another at the least total distance.

Costs are sums of absolute differences. Vectors are cut in blocks of coordinates; blocks of the two sides are joined, and
partial sums are added up by pair of units. Each pair of experts is then one small matrix and a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least cost (shortest augmenting paths; n^3 steps for n rows).

    Rows may be fewer than columns. Each row is entered by a shortest path, in costs reduced by prices of rows and columns, to a
    free column; the prices then change so that reduced costs stay non-negative and those on the matching zero.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for row in range(n):
        far, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        here, reached, column = row, 0.0, -1
        while True:
            # Costs of going on from the row that is reached.
            step = reached + cost[here] - row_price[here] - column_price
            better = ~done & (step < far)
            far[better], via[better] = step[better], column
            column = int(np.argmin(np.where(done, np.inf, far)))
            reached = far[column]
            done[column] = True
            if row_of[column] < 0:
                break
            here = row_of[column]
        passed = done & (row_of >= 0)
        row_price[row] += reached
        row_price[row_of[passed]] += reached - far[passed]
        column_price[done] -= reached - far[done]
        while column >= 0:  # along the path each column goes to the row before
            before = via[column]
            row_of[column] = row if before < 0 else row_of[before]
            column = before
    out = np.empty(n, np.int64)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def unit_costs(units: DataFrame, layer: str, expert: str, unit: str, vector: str, dominant: DataFrame, block: int = 16) -> DataFrame:
    """(layer, expert, i, j, cost): distances of the units of each expert to those of its layer's dominant one; dominant (layer, expert)."""
    cut = F.expr(f"transform(sequence(0, cast(ceil(size({vector}) / {block}) as int) - 1), k -> slice({vector}, k * {block} + 1, {block}))")
    parts = units.where(F.size(vector) > 0).select(F.col(layer).alias("_l"), F.col(expert).alias("_e"), F.col(unit).alias("_u"), F.posexplode(cut).alias("_b", "_x"))
    first = dominant.select(F.col(layer).alias("_l"), F.col(expert).alias("_e"))
    other = parts.join(first, ["_l", "_e"]).select("_l", "_b", F.col("_u").alias("j"), F.col("_x").alias("_y"))
    pairs = parts.join(first, ["_l", "_e"], "left_anti").join(other, ["_l", "_b"])
    far = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)
    return pairs.groupBy("_l", "_e", F.col("_u").alias("i"), "j").agg(F.sum(far).alias("cost")).select(F.col("_l").alias(layer), F.col("_e").alias(expert), "i", "j", "cost")


def permute_units(costs: DataFrame, layer: str, expert: str) -> DataFrame:
    """(layer, expert, unit, matched, cost) of least total cost for each expert; ties go to smaller units."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="i", columns="j", values="cost").sort_index().sort_index(axis=1)
        matched = assign(grid.to_numpy())
        return pd.DataFrame({layer: pdf[layer].iloc[0], expert: pdf[expert].iloc[0], "unit": grid.index, "matched": grid.columns[matched], "cost": grid.to_numpy()[np.arange(len(grid)), matched]})

    kinds = dict(costs.dtypes)
    return costs.groupBy(layer, expert).applyInPandas(solve, f"{layer} {kinds[layer]}, {expert} {kinds[expert]}, unit {kinds['i']}, matched {kinds['j']}, cost double")
