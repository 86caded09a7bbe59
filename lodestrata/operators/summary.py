"""Histograms and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import markup, paths


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """(value, n), the most frequent first, equal counts by descending value."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("value"))


def extensions(df: DataFrame, path: str) -> DataFrame:
    """Histogram of extensions, case as written; names without one don't count."""
    names = df.select(paths.basename(F.col(path)).alias("name")).where(paths.has_extension(F.col("name")))
    return histogram(names, paths.last_extension(F.col("name")))


def types(df: DataFrame, content_type: str) -> DataFrame:
    return histogram(df, markup.base_type(F.col(content_type)))


def inventory(df: DataFrame, path: str, *but: str) -> DataFrame:
    """Distinct paths, without the named control files."""
    return df.where(F.col(path).isNotNull() & ~F.col(path).isin(*but)).select(F.col(path).alias("path")).distinct()


def first_volume(df: DataFrame, path: str) -> DataFrame:
    """The first name in order that isn't a control name, of a leading './' freed."""
    name = F.regexp_replace(F.col(path), r"^\./", "")
    return df.select(name.alias("path")).where(F.col("path").isNotNull() & ~F.col("path").rlike(paths.CONTROL_NAMES)).agg(F.min("path").alias("path"))


#: Extensions of what is expanded.
CONTAINERS = ("zip", "gz", "7z", "gzip", "tar", "tgz", "bz2", "xz", "rar", "pst")


def archives(df: DataFrame, path: str, *kinds: str) -> DataFrame:
    """Rows whose path has one of the extensions, in any case."""
    return df.where(F.lower(F.col(path)).rlike(rf"\.({'|'.join(kinds or CONTAINERS)})$"))
