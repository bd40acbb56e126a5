"""Intermediate results written once to shared storage.

Backends must be called once per chunk and positions must not move between
two readings, so such results are written as parquet under the checkpoint
folder of the session. Unlike ``checkpoint()`` the files keep column pruning.
Who knows when they have served their purpose records and removes them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


def shared_path(spark: SparkSession, path: str):
    """The file system of a path and the path, for names and existence of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = shared_path(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = shared_path(spark, path)
    files.delete(place, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    files, place = shared_path(spark, path)
    return [child.getPath().getName() for child in files.listStatus(place)]


@contextmanager
def recorded_stages() -> Iterator[list[str]]:
    """Lists what is staged in the block, so that it can be removed later."""
    made: list[str] = []
    token = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(token)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local path would vanish with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="feedloom-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, cutting its lineage."""
    path = f"{checkpoint_root(df.sparkSession)}/feedloom/{uuid.uuid4().hex}/{name}"
    made = _recorded.get()
    if made is not None:
        made.append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
