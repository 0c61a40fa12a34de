"""Tables in the folder that driver and executors share: written at once, read again, and deleted when their use is over."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or, where that is unset, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinespark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of the scratch() blocks that are open, the innermost last.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stage() writes inside the block are deleted at its end, except those that it is told to keep.

    What the block returns must not read the deleted ones. The driver also lets go of plans that nothing refers to any
    more, so that Spark's cleaner removes their shuffle files.
    """
    path = f"{stage_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*_SCRATCH.get(), path))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, path)
        gc.collect()
        spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_dir(spark: SparkSession) -> str:
    """The folder that stage() writes to just now."""
    return (shared_dir(spark), *_SCRATCH.get())[-1]


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here and a lost executor costs nothing.

    Within scratch() the table lives as long as the block; with keep it lives as long as the block around that one.
    """
    spark = df.sparkSession
    folders = (shared_dir(spark), *_SCRATCH.get())
    path = f"{folders[-2 if keep and len(folders) > 1 else -1]}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("error").parquet(path)
    return spark.read.schema(schema).parquet(path)
