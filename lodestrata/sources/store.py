"""Names in whatever file system a path belongs to."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; one of our own only where none is set and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "lodestrata-checkpoints")
    return where


def mounted(path: str) -> str:
    """A path of a file system that is mounted on all executors, without its scheme."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} isn't mounted")
    return re.sub("^file:(//)?", "", path)


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _open(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def total_size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of files; many of one folder are asked for at once, so it counts what else the folder holds."""
    folders = {p.rsplit("/", 1)[0] for p in paths}
    total = 0
    for path in paths if len(paths) <= 64 else folders:
        fs, p = _open(spark, path)
        total += fs.getContentSummary(p).getLength()
    return total


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, path: str, folder: str) -> bool:
    """A path moved into a folder, which is made if it is missing."""
    fs, p = _open(spark, path)
    _, to = _open(spark, folder)
    fs.mkdirs(to)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to, p.getName()))


def remove_at_end(spark: SparkSession, path: str) -> None:
    """The path is removed when the driver's process ends."""
    fs, p = _open(spark, path)
    fs.deleteOnExit(p)
