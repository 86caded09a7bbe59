"""What the operators on texts share: reading the tables, Arrow maps, whole-table sketches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources import store
from lodestrata.sources.lines import spread, table


def contents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(sha256, content, more...) of the index, one row per PUT with a non-empty content.

    A document that was PUT again is there again; the operators drop repeats from their
    results, which are smaller than the texts.
    """
    index = table(spark, sf_dir, "leakdata_index")
    rows = index.where(F.col("sha256").isNotNull() & (F.col("attachment.content") != ""))
    return spread(rows.select("sha256", F.col("attachment.content").alias("content"), *more))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable] | None]], schema: str | T.StructType) -> DataFrame:
    """Map batches of columns to batches of columns in Python; ``make`` runs once per task and returns the map.

    A batch is given as lists of Python values in at most a few MB of text.
    """
    names = df.columns
    types = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = f({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=field.type) for x, field in zip((out[f.name] for f in arrow), arrow)], schema=arrow)
        end = getattr(f, "end", None)
        if end and (out := end()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(out[field.name], type=field.type) for field in arrow], schema=arrow)

    return df.mapInArrow(run, types)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, set as the folder of checkpoints."""
    where = store.shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder, with its lineage cut; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read again, so that later steps read the columns they
    need; survives lost executors. The table is removed when the driver ends."""
    spark = df.sparkSession
    where = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(where)
    store.remove_at_end(spark, where)
    return spark.read.schema(df.schema).parquet(where)
