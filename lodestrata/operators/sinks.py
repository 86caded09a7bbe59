"""What is written: summaries, lists, marks of completion, and what is done with a container afterwards."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import summary
from lodestrata.sources import store


def summaries(df: DataFrame, path: str, content_type: str, folder: str) -> None:
    """Histograms of extensions and media types and the inventory of paths, a folder each."""
    summary.extensions(df, path).write.mode("overwrite").csv(f"{folder}/extensions", header=True)
    summary.types(df, content_type).write.mode("overwrite").csv(f"{folder}/types", header=True)
    summary.inventory(df, path).write.mode("overwrite").text(f"{folder}/paths")


def lists(df: DataFrame, name: str, line: str, folder: str) -> None:
    """Lines appended to a list by name."""
    df.select(F.col(name).alias("list"), F.col(line).alias("value")).write.mode("append").partitionBy("list").text(folder)


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write ended well; a step whose result is finished isn't repeated."""
    return store.exists(spark, f"{folder}/_SUCCESS")


def after_expansion(archive: bool, remove: bool) -> str:
    """What becomes of a container once its members are written; keeping it wins over removing it."""
    return "archive" if archive else "remove" if remove else "keep"


def clean_up(spark: SparkSession, containers: list[str], archive_to: str | None, remove: bool) -> dict[str, str]:
    """Containers whose members are written moved to a folder, or else removed, or kept; what became of each.
    It comes after the write of the members has succeeded."""
    done = {}
    for path in containers:
        done[path] = after_expansion(archive_to is not None, remove)
        if archive_to is not None:
            store.move(spark, path, archive_to)
        elif remove:
            store.remove(spark, path)
    return done


def mark(spark: SparkSession, folder: str, stage: str, at: str) -> None:
    """A row that says that a run has reached a stage, added to its status; a stage that is marked stays as it was."""
    known = spark.read.parquet(folder) if store.names(spark, folder) else None
    if known is None or known.where(F.col("stage") == stage).isEmpty():
        spark.createDataFrame([(stage, at)], "stage string, at string").coalesce(1).write.mode("append").parquet(folder)


def drop_expired(spark: SparkSession, folder: str, column: str, today: date, days: int) -> list[str]:
    """Day partitions of a table that are older than some days, removed; their names."""
    limit, gone = today - timedelta(days=days), []
    for name in store.names(spark, folder):
        if name.startswith(f"{column}=") and date.fromisoformat(name.split("=", 1)[1]) < limit:
            store.remove(spark, f"{folder}/{name}")
            gone.append(name)
    return gone
