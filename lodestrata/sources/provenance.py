"""Where contents came from: a table of (original_filename, sha256), and its form as a file of a local database."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def create_if_missing(spark: SparkSession, name: str) -> bool:
    """An empty table of provenance, unless there is one; whether it was made."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT, original_filename STRING NOT NULL, sha256 STRING NOT NULL) USING parquet")
    return not there


def from_database(spark: SparkSession, path: str, table: str = "files", parts: int = 8) -> DataFrame:
    """(id, original_filename, sha256) of a database file that all executors can reach, read in ranges of rows."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {table}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("original_filename", pa.string()), ("sha256", pa.string())])
        for b in batches:
            for begin in b.column("id").to_pylist():
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    rows = db.execute(f"SELECT rowid, original_filename, sha256 FROM {table} WHERE rowid >= ? AND rowid < ?", (begin, begin + step))
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)

    ranges = spark.range(low, high + 1, step, numPartitions=max(1, min(parts, -(-(high - low + 1) // step))))
    return ranges.mapInArrow(run, "id long, original_filename string, sha256 string")
