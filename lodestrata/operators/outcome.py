"""Outcomes of an ingest, stage flags, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def size_gate(df: DataFrame, length: str, most: int) -> DataFrame:
    """All rows with an outcome; two branches, so that the bound reaches a file scan as a pushed filter."""
    kept = df.where(F.col(length) <= most).withColumn("outcome", F.lit("ok"))
    large = df.where(F.col(length) > most).withColumn("outcome", F.lit("too large"))
    return kept.unionByName(large)


def outcome(message: Column, content: Column) -> Column:
    """What became of a record, from its message and text."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.isin("to large", "too large"), "too_large")
        .when(m.rlike(r"^empty"), "empty")
        .when(m.rlike(r"^http 4|rejected|unsupported"), "rejected")
        .when(m.rlike(r"timed out|reset by peer"), "transport")
        .when(m == "ok", F.when(F.coalesce(F.length(content), F.lit(0)) > 0, "indexed").otherwise("no_text"))
        .when(m == "", "unknown")
        .otherwise("error")
    )


def stage(flags: dict[str, Column]) -> Column:
    """Name of the stage a run is in, from its flags; the furthest flag holds."""
    order = [("ingest_done", "finished"), ("extracted_done", "ingesting"), ("unpack", "extracting"), ("extract", "extracting"), ("downloaded", "downloaded"), ("running", "downloading"), ("added_urls", "queued"), ("downloader_up", "ready"), ("setup", "ready")]
    out = None
    for flag, name in order:
        if flag in flags:
            out = F.when(flags[flag], name) if out is None else out.when(flags[flag], name)
    return out.otherwise("waiting")


def states(flags: dict[str, Column]) -> dict[str, Column]:
    """A state for each stage of a run, from its flags; a flag that isn't given is not set."""
    on = lambda name: F.coalesce(flags.get(name, F.lit(False)), F.lit(False))
    return {
        "setup": F.when(on("setup"), "DONE").otherwise("RUN SETUP"),
        "urls": F.when(on("added_urls"), "DONE").when(on("downloader_up"), "RUNNING").otherwise("NO DOWNLOAD CONTAINER"),
        "download": F.when(on("downloaded"), "DONE").when(on("running"), "RUNNING").otherwise("NOT RUNNING"),
        "move": F.when(on("unpack"), "DONE").when(on("extract"), "RUNNING").otherwise("WAITING FOR FILES"),
        "extraction": F.when(on("extracted_done"), "DONE").when(on("unpack"), "RUNNING").otherwise("WAITING FOR FILES"),
        "ingest": F.when(on("ingest_done"), "DONE").when(on("extracted_done"), "RUNNING").otherwise("WAITING FOR FILES"),
    }


def edges(df: DataFrame, key: str, order: str, state: Column, before: str, after: str) -> DataFrame:
    """(key, order) of the rows in which a key's state turns from one into another; the rows of a key are few."""
    last = F.lag("state").over(Window.partitionBy(key).orderBy(order))
    return df.select(key, order, state.alias("state")).withColumn("last", last).where((F.col("last") == before) & (F.col("state") == after)).select(key, order)


def expired(df: DataFrame, name: str, created: str, prefix: str, at: str, days: int) -> DataFrame:
    """Named indices of a prefix that were created more than some days before a time."""
    return df.where(F.col(name).startswith(prefix) & (F.col(created) < F.expr(f"timestamp '{at}' - interval {days} days")))


def lookup_status(valid: Column, found: Column, failed: Column | None = None) -> Column:
    """What a request for a hash is answered with; 500 where its content can't be read or converted."""
    out = F.when(~valid, 400).when(~found, 404)
    return (out if failed is None else out.when(failed, 500)).otherwise(200)


def retry_outcome(statuses: Column, ok: tuple[int, ...] = (200, 201), most: int = 5) -> Column:
    """First good status of the first tries, 400 where it was refused, else null."""
    tried = F.slice(statuses, 1, most)
    return F.try_element_at(F.filter(tried, lambda s: s.isin(*ok, 400)), F.lit(1))


def retried(df: DataFrame, key: str, order: str, status: str, most: int = 5) -> DataFrame:
    """(key, outcome) of the first tries of each key, in order."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most)
    tries = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", status))).alias("t"))  # at most that many each
    return tries.select(key, retry_outcome(F.transform("t", lambda x: x[status]), most=most).alias("outcome"))
