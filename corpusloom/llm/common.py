"""What several training-data operators share: scratch tables, checked broadcasts, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast if its rows take at most so many bytes, counted as ROW_BYTES of its schema a row.
BROADCAST_BYTES = 32 << 20

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests) takes a
    temporary one; on a cluster, whose machines share no temporary folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    if not found:
        key = spark.sparkContext.applicationId
        if key not in _roots:
            _roots[key] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        found = _roots[key]
    if "://" not in found:  # a bare path means the default file system, which readers beside Spark would not know
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = re.sub(r"^file:/(?!/)", "file:///", store.makeQualified(path).toString())
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; quietly at exit, when the JVM may be gone."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway is closed
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a hash table: 32, and 8 a number or 320 a column without a fixed size (digests, sketches)."""
    return 32 + sum(320 if t in ("string", "binary") or t.startswith(("array", "map", "struct")) else 8 for _, t in df.dtypes)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit of bytes; else Spark shuffles (and AQE splits skew)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes(df) <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in edges (a, b) of longs; component: the smallest node reachable.

    Each round hooks a node to its smallest neighbour or itself (a partially aggregated minimum, so that hubs do not
    gather in a task), follows the hooks twice, and contracts: edges become those between the nodes arrived at, each once.
    So what is left shrinks by some factor every round, and rounds grow with the logarithm of a component's diameter.
    At the end the rounds' hooks are put together. All tables are written to the shared folder.
    """
    left = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        hooks = left.union(left.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        for _ in range(2):
            # A hub is the hook of very many nodes: AQE splits the skewed side of this join. Every hook is a node here.
            hooks = materialise(hooks, "hooks")
            hooks = hooks.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("further")), "up").select("node", F.col("further").alias("up"))
        hooks = materialise(hooks, "hooks")
        rounds.append(hooks)
        ends = left.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        left = materialise(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for hooks in reversed(rounds):
        after = found.select(F.col("node").alias("up"), "component")
        found = materialise(hooks.join(after, "up", "left").select("node", F.coalesce("component", "up").alias("component")), "labels")
    return found
