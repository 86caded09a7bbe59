"""Contents by their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import paths
from lodestrata.operators import dedupe, ingest, outcome


def served(asked: DataFrame, known: DataFrame, most: int = ingest.MOST) -> DataFrame:
    """(sha256, path, status, content) of each hash that is asked for: 400 if it is none, 404 if no file has it, 500 if the
    file can't be read. ``known`` has (sha256, path, length); of the files of a hash the one with the least path is read."""
    one = dedupe.first_wins(known.where(F.col("sha256").isNotNull()).select("sha256", "path", "length"), "sha256", "path")
    # A tree's size is estimated from its few folders, so without the hint all of it would be broadcast. Contents are read
    # after the join: only hashes and paths are exchanged.
    read = ingest.with_content(asked.select("sha256").distinct().join(one.hint("merge"), "sha256", "left"), most)
    status = outcome.lookup_status(paths.valid_hash(F.col("sha256")), F.col("path").isNotNull(), F.col("error").isNotNull())
    return read.select("sha256", "path", status.alias("status"), "content")
