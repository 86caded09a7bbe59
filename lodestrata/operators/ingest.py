"""From a file tree to indexed documents: scan, hash, choose, read, write."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.operators import dedupe, extract
from lodestrata.sources import files, store

MOST = 314_572_800
#: Bytes that are copied at once.
CHUNK = 1 << 20


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Named steps composed into one."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


#: Bytes of contents that a batch holds, besides the one that goes over it.
BATCH_BYTES = 64 << 20


def with_content(df: DataFrame, most: int = MOST, batch: int = BATCH_BYTES) -> DataFrame:
    """With content, the bytes of files up to a size, and error; larger ones are never opened, one that can't be read
    has an error instead, and a row without a path has neither. A batch is cut by the bytes it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, errors, begin, held = [], [], 0, 0
            for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                got, error = (None, None) if p is None or n is not None and n > most else _read(p, most)
                data.append(got)
                errors.append(error)
                held += len(got or b"")
                if held >= batch:
                    yield made(b, begin, data, errors)
                    begin, data, errors, held = begin + len(data), [], [], 0
            if data:
                yield made(b, begin, data, errors)

    def made(b: pa.RecordBatch, begin: int, data: list, errors: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.slice(begin, len(data)).columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*b.schema.names, "content", "error"])

    names = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{names}, content binary, error string")


def _read(path: str, most: int) -> tuple[bytes | None, str | None]:
    try:
        with open(path, "rb") as f:
            got = f.read(most + 1)  # it may have grown
        return (got, None) if len(got) <= most else (None, None)
    except OSError as e:
        return None, f"{type(e).__name__}: {e.strerror}"


def documents(spark: SparkSession, root: str, known: DataFrame | None = None, provenance: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """A document per distinct content that isn't known yet; the smallest path names it.

    Hash and document are written together, so a run that breaks off loses nothing and a repeated run adds nothing.
    """
    found = files.hashed(files.file_tree(spark, root))
    good = found.where(F.col("sha256").isNotNull()).select("path", "mtime", "length", "sha256")
    one = dedupe.first_wins(good, "sha256", "path")
    if known is not None:
        one = dedupe.unseen(one, known, "sha256")
    read = extract.extracted(with_content(one.select("path", "mtime", "length", "sha256"), most)).withColumn("message", F.coalesce(F.concat(F.lit("error: "), F.col("error")), F.col("message")))
    if provenance is not None:
        read = read.join(provenance.select("sha256", "original_filename"), "sha256", "left")
    else:
        read = read.withColumn("original_filename", F.lit(None).cast("string"))
    return read.select(
        F.coalesce("original_filename", "path").alias("filename"), "sha256", "mtime", "message",
        F.struct(F.col("text").alias("content"), "content_type", F.col("length").alias("content_length"), "title", F.lit(None).cast("string").alias("language")).alias("attachment"),
        F.timestamp_seconds("mtime").alias("timestamp"),
    )


def append(df: DataFrame, where: str) -> int:
    """Documents of new hashes appended to a Parquet table, one for each hash; how many there were. Rows without a hash aren't kept."""
    spark = df.sparkSession
    df = dedupe.first_wins(df.where(F.col("sha256").isNotNull()), "sha256", *("filename",) if "filename" in df.columns else ("sha256",))
    if store.names(spark, where):
        df = dedupe.unseen(df, spark.read.parquet(where), "sha256")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(where)
    return seen.get["n"]


def upserted(table: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The table with rows of the same key replaced; of the new rows of a key the last in the order holds. Null is no key: such
    new rows are left out, and the table's stay."""
    new = dedupe.last_wins(new.where(F.col(key).isNotNull()), key, *order or (key,))
    return dedupe.unseen(table, new, key).unionByName(new, allowMissingColumns=True)


def relocate(df: DataFrame, target: str) -> DataFrame:
    """Files copied to their content address; (sha256, path, target, copied). What is there already isn't copied again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, to = [], [os.path.join(target, a) for a in b.column("address").to_pylist()]
            for p, q in zip(b.column("path").to_pylist(), to):
                new = not os.path.exists(q)
                if new:
                    os.makedirs(os.path.dirname(q), exist_ok=True)
                    part = f"{q}.{uuid.uuid4().hex}.part"
                    with open(p, "rb") as f, open(part, "wb") as g:
                        shutil.copyfileobj(f, g, CHUNK)
                    os.replace(part, q)
                done.append(new)
            yield pa.RecordBatch.from_arrays([b.column("sha256"), b.column("path"), pa.array(to, pa.string()), pa.array(done, pa.bool_())], names=["sha256", "path", "target", "copied"])

    placed = df.select("sha256", "path", paths.content_address(F.col("sha256"), F.col("path")).alias("address"))
    return placed.mapInArrow(run, "sha256 string, path string, target string, copied boolean")


def provenance(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(original_filename, sha256), the first name of each hash, without the known hashes."""
    first = dedupe.first_wins(df.select("sha256", "path"), "sha256", "path").select(F.col("path").alias("original_filename"), "sha256")
    return first if known is None else dedupe.unseen(first, known, "sha256")
