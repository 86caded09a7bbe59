"""One row per key, and rows that are or aren't known yet.

First and last wins are aggregates, not windows: each task keeps one candidate per key before
the shuffle, so a key that a third of all rows have costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: str, order: Column, best) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(best(F.struct(*rest), order).alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes first in the order; later ones are ignored."""
    return _pick(df, key, F.struct(*order), F.min_by)


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last in the order, as if each overwrote those before."""
    return _pick(df, key, F.struct(*order), F.max_by)


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def seen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def groups(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """(key, first id, n) of the rows that share a key."""
    return df.groupBy(key.alias("key")).agg(F.min(id_).alias("first_id"), F.count("*").alias("n"))
