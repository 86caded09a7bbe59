"""File trees as tables.

Names are listed with dot-files, which Spark's own file sources skip; all but the folders of the
first levels are listed, and all bytes are read, in the tasks.  A path must be reachable from all executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL_FILES = ("done", "path.txt")
BLOCK = 1 << 20


def file_tree(spark: SparkSession, root: str, but: tuple[str, ...] = CONTROL_FILES, levels: int = 2) -> DataFrame:
    """(path, mtime, length) of all regular files below a root, control files at the root left out.

    The driver lists the folders of the first levels only; the tasks walk what lies below them.
    """
    todo, rows = [(root, 0)], []
    while todo:
        at, depth = todo.pop()
        rows.append((at, depth >= levels))
        if depth < levels:
            todo += [(e.path, depth + 1) for e in os.scandir(at) if e.is_dir(follow_symlinks=False)]
    unwanted = {os.path.join(root, n) for n in but}

    def walk(at: str, deep: bool) -> Iterator[tuple[str, int, int]]:
        for folder, _, names in os.walk(at):
            for n in names:
                p = os.path.join(folder, n)
                if p not in unwanted and os.path.isfile(p) and not os.path.islink(p):
                    st = os.stat(p)
                    yield p, int(st.st_mtime), st.st_size
            if not deep:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("length", pa.int64())])
        for b in batches:
            for at, deep in zip(b.column("folder").to_pylist(), b.column("deep").to_pylist()):
                found = walk(at, deep)
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)

    folders = spark.createDataFrame(rows, "folder string, deep boolean").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    # Files of a large folder are spread again before their bytes are read.
    return folders.mapInArrow(run, "path string, mtime long, length long").repartition("path")


def hashed(files: DataFrame) -> DataFrame:
    """With sha256, read in blocks whatever the size; a file that can't be read has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_hash(p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h for h, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*b.schema.names, "sha256", "error"])

    return files.mapInArrow(run, "path string, mtime long, length long, sha256 string, error string")


def _hash(path: str) -> tuple[str | None, str | None]:
    try:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(BLOCK):
                h.update(block)
        return h.hexdigest(), None
    except OSError as e:
        return None, str(e)


def binary_scan(spark: SparkSession, root: str, most: int, glob: str | None = None) -> DataFrame:
    """(path, mtime, length, content) by Spark's own reader; contents above the bound are null.

    Two branches, so that the bound on the length is pushed to the reader and large files aren't read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    mtime = F.unix_timestamp("modificationTime").alias("mtime")
    small = df.where(F.col("length") <= most).select(path.alias("path"), mtime, "length", "content")
    large = df.where(F.col("length") > most).select(path.alias("path"), mtime, "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)
