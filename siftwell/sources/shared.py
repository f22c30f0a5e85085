"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent on one machine (a local master, as in tests) a
    temporary folder takes its place; on a cluster that is an error, as executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that were made inside of the open ``scratch`` blocks, innermost last.
_MADE: list[list[str]] = []


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, the path as it takes it)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def published(spark: SparkSession, made: str, path: str) -> None:
    """Give the folder ``made`` the name ``path`` in one step; an error if that is there already."""
    fs, source = file_system(spark, made)
    _, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{made} can't be renamed to {path}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end, also after an error."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            deleted(spark, path)


class Stages:
    """Tables of a job's stages that a later run takes up again.

    A stage's table is named by a fingerprint of what the job was given, so only a run with the same input and parameters
    finds it. It is written under another name and renamed when it is whole.
    """

    def __init__(self, spark: SparkSession, *given):
        self.spark, self.names = spark, []
        self.key = hashlib.sha256(repr(given).encode()).hexdigest()[:24]

    def path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/siftwell-stage-{self.key}-{name}"

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of the stage, made by ``make`` unless a run before this one has."""
        path = self.path(name)
        self.names.append(name)
        if not exists(self.spark, path):
            part = f"{path}-{uuid.uuid4().hex}"
            try:
                make().write.option("compression", "zstd").parquet(part)
                published(self.spark, part, path)
            finally:
                deleted(self.spark, part)
        return self.spark.read.parquet(path)

    def close(self) -> None:
        """Delete the tables of all stages that were asked for: the job is done."""
        for name in self.names:
            deleted(self.spark, self.path(name))


def fingerprint(spark: SparkSession, root: str) -> str:
    """What tells whether files under ``root`` have changed: their number, and a sum over hashes of path, size and time. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    row = files.agg(F.count("*").alias("n"), F.sum(each).alias("s")).first()
    return f"{row.n}:{row.s}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends at the table, so a lost executor costs no recomputation. Inside of ``scratch`` the table
    goes at its end; elsewhere it stays, as a result may still be read from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{tag}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
