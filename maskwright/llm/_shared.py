"""Intermediate tables and files in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Session setting that deletes an execution's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder of our own only where it is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="maskwright-"))
    return _own[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that no column begins with, for internal names beside a caller's columns."""
    taken, prefix = [c.lower() for c in columns], "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


class Scratch:
    """Writes cut lineage at a table; ``drop`` frees a table once nothing lazy reads it.

    A written table survives the loss of any executor, so the shuffle files that
    fed it go as soon as it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, frame: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            frame.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
