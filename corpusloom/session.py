"""Session factory for local runs, tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session with the settings that the plans assume (UTC, AQE, Arrow)."""
    memory = os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "6g")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the store that the cluster shares (spark.checkpoint.dir). Where it is unset a local session takes
    a temporary one; on a cluster, whose machines share no temporary folder, that is an error."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    return f"{shared.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"corpusloom-{name}-")
