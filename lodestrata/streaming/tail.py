"""Streams of lines and records, from folders, with checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.sources.lines import json_lines


def lines(spark: SparkSession, folder: str, *tags: str, per_run: int | None = None) -> DataFrame:
    """New lines of a folder's files, each with literal tags."""
    reader = spark.readStream.format("text")
    if per_run:
        reader = reader.option("maxFilesPerTrigger", per_run)
    return reader.load(folder).withColumn("tags", F.array(*map(F.lit, tags)).cast("array<string>"))


def records(stream: DataFrame) -> DataFrame:
    """Log records with an event time, from lines that are whole JSON objects."""
    return json_lines(stream).withColumn("at", event_time(F.col("ts")))


def event_time(ts: Column) -> Column:
    """A time written as text or as seconds or milliseconds."""
    n = ts.try_cast("double")
    return F.coalesce(F.try_to_timestamp(ts), F.timestamp_millis(F.when(n > 1e11, n).otherwise(n * 1000).cast("bigint")))


def tumbling(df: DataFrame, at: str, size: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts in windows of a size; with ``late`` as a stream with a watermark."""
    if late:
        df = df.withWatermark(at, late)
    return df.groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def socket_lines(spark: SparkSession, host: str, port: int, *tags: str) -> DataFrame:
    """Lines of a network log; a socket can't be read twice, so it is for tests and hand-offs."""
    reader = spark.readStream.format("socket").option("host", host).option("port", port)
    return reader.load().withColumn("tags", F.array(*map(F.lit, tags)).cast("array<string>"))


def edges(stream: DataFrame, key: str, order: str, state: str, before: str, after: str) -> DataFrame:
    """(key, order) whenever a key's state turns from one into another; only its last state is kept."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        old = [last.get[0] if last.exists else None, *rows[state].tolist()]
        hits = [a == before and b == after for a, b in zip(old, old[1:])]
        last.update((old[-1],))
        yield pd.DataFrame({key: k[0], order: rows[order][hits]})

    return (
        stream.select(key, order, state).groupBy(key)
        .applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", "state string", "append", GroupStateTimeout.NoTimeout)
    )


def sink(stream: DataFrame, folder: str, checkpoint: str, by: str | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """What the stream brings written as Parquet: all there is at the start, or again ``every`` "1 minute". A second run on
    the checkpoint takes only what is new."""
    when = {"processingTime": every} if every else {"availableNow": True}
    w = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**when)
    return (w.partitionBy(by) if by else w).start()
