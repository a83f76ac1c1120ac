"""Rewards that wait for something else (services, files): many calls in flight in each task.

The calls of an Arrow batch run on one event loop, never more than `limit` at a time; results come back in the order of the
rows. A call that fails or takes longer than `timeout` seconds has the result `failed`, and the row stays.
"""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType


async def gather(call: Callable[[dict], Awaitable[float | None]], rows: list[dict], limit: int, timeout: float, failed: float | None) -> list[float | None]:
    """Results of call(row), in order."""
    free = asyncio.Semaphore(limit)

    async def one(row: dict) -> float | None:
        async with free:
            try:
                got = await asyncio.wait_for(call(row), timeout)
                return None if got is None else float(got)
            except (asyncio.CancelledError, KeyboardInterrupt):
                raise
            except Exception:  # noqa: BLE001  whatever a service does, its row has a result
                return failed

    return list(await asyncio.gather(*map(one, rows)))


def concurrent_rewards(df: DataFrame, columns: list[str], call: Callable[[dict], Awaitable[float | None]], name: str = "reward", limit: int = 64, timeout: float = 30.0, failed: float | None = None) -> DataFrame:
    """df with `name`: call gets a row's `columns` as a dict and returns a number or null."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with asyncio.Runner() as loop:
            for batch in batches:
                got = loop.run(gather(call, batch.select(columns).to_pylist(), limit, timeout, failed))
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(got, pa.float64())], schema=arrow)

    return df.mapInArrow(run, schema)
