"""Session helpers: durable cuts of lineage and the shared folder they live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, since there the driver and the
    executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="newsloom-")
    sc.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run's tables or stream state.

    It is removed when the driver ends, since results that read it may be asked for until then.
    """
    parent = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/run"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts the lineage.

    A checkpoint runs its plan once to count and once to write; holding the rows meanwhile saves
    the second run. They are let go as soon as the files are there.
    """
    shared_dir(df.sparkSession)
    held = df.persist()
    out = held.checkpoint()
    held.unpersist()
    return out


@contextmanager
def arrow_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs run inside send Python at most ``limit`` bytes and a row in an Arrow batch, or less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    chosen, given = name in spark.conf.getAll, spark.conf.get(name)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) <= limit:
        spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, given) if chosen else spark.conf.unset(name)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoint files of ``durable`` tables that nothing will read again."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        file = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
