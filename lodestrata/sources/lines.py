"""Lines, lists of addresses, JSON records and settings."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import delimited_field
from lodestrata.schema import LOG


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where a file or two hold them in fewer parts than that, such as one row group; a
    table of many files or row groups stays as it is, so what is exchanged is small."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = df.select(F.spark_partition_id().alias("part")).distinct().limit(cores).count()
    return df if 2 * parts > cores else df.repartition(cores)


def url_list(spark: SparkSession, *folders: str) -> DataFrame:
    """Distinct addresses of all lists, in order."""
    return spark.read.text(list(folders)).where(F.trim("value") != "").select(F.trim("value").alias("url")).distinct().orderBy("url")


def links(df: DataFrame, page: str, ending: str) -> DataFrame:
    """(link) of pages that list files: of each line with a link to a name of the ending, what its first pair of quotes holds."""
    lines = df.select(F.explode(F.split(page, "\n")).alias("line")).where(F.col("line").rlike(rf"{ending}</a>"))
    return lines.select(delimited_field(F.col("line"), '"', 2).alias("link"))


def any_line(df: DataFrame, value: str = "value") -> bool:
    """Whether a list has a line that isn't blank; reads no more than it needs."""
    return not df.where(F.trim(value) != "").limit(1).isEmpty()


def members(df: DataFrame, value: str, array: str = "$.result") -> DataFrame:
    """With ``item``, each member of the array of a JSON response, as a variant; other texts have none."""
    found = df.withColumn("_a", F.try_variant_get(F.try_parse_json(value), array, "array<variant>"))
    return found.select("*", F.explode("_a").alias("item")).drop("_a")


def json_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Log records of the lines that are whole JSON objects; numbers may be written as text and times either way."""
    ok = df.where(F.trim(value).startswith("{")).select(F.try_parse_json(value).alias("v")).where("v IS NOT NULL")  # parsed once
    return ok.select(*(F.try_variant_get("v", f"$.{f.name}", "string").try_cast(f.dataType).alias(f.name) for f in LOG))


def parsed(df: DataFrame, value: str = "value") -> DataFrame:
    """With ``v``, the JSON of each text, parsed once; null where the text is none."""
    return df.withColumn("v", F.try_parse_json(value))


def json_field(v: Column, path: str) -> Column:
    """Member of a parsed JSON text as text; null where there is none."""
    return F.try_variant_get(v, path, "string")


def json_text(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})


def settings(path: str, environment: Mapping[str, str] = os.environ) -> dict[str, dict[str, str]]:
    """Sections of an INI file; SECTION_NAME in the environment comes first. A file without sections is an error."""
    parser = configparser.RawConfigParser()
    parser.read(path)
    if not parser.sections():
        raise ValueError(f"no sections in {path}")
    return {s: {k: environment.get(f"{s}_{k}".upper(), v) for k, v in parser[s].items()} for s in parser.sections()}


def flag(config: dict[str, dict[str, str]], section: str, name: str) -> bool:
    """A setting read as a truth value; a line that is commented out doesn't count."""
    return config.get(section, {}).get(name, "false").strip().lower() in ("true", "yes", "on", "1")
