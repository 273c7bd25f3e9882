"""Where intermediate and result tables live.

Intermediate tables are written to the folder all executors share
(``spark.checkpoint.dir``), so losing an executor never loses them, and reading
them back gives Catalyst their real size: a small table is then broadcast by
Spark's own threshold, a large one is joined by a shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: codec of tables on the shared folder: hashes and texts take about half of Spark's default
PACKING = "zstd"

#: intermediate tables of the job that runs, to be removed at its end
_OPEN: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may go without: it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tenderwatch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/tenderwatch/{app}/{label}-{uuid.uuid4().hex[:12]}"
    if (noted := _OPEN.get()) is not None:
        noted.append(path)
    return path


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=PACKING)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names under a folder; none if it does not exist."""
    if not exists(spark, path):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(folder)]


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what is settled inside; for jobs that write their result before it."""
    noted: list[str] = []
    token = _OPEN.set(noted)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in noted:
            remove(spark, path)
