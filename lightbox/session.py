"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lightbox") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the caller brings its own session; nothing in this package
    relies on the settings made here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LIGHTBOX_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there the driver
    and the executors are one process, so the folder is shared by definition.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`durable` writes inside go when the block ends.

    Results that read them must be written by then, like a job's output.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession, kind: str, keep: bool = False) -> str:
    """A new path below the checkpoint folder. Unless ``keep`` is set, it goes with a surrounding :func:`temporary_tables`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back, cutting its lineage.

    With ``keep`` the table outlives a surrounding :func:`temporary_tables`.

    On shared storage, so a lost executor costs a re-read and never a second
    evaluation of anything whose layout is not reproducible. A written table
    also keeps column pruning and tells its true size to the join planner.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "durable", keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
