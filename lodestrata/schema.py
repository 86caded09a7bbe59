"""Shapes of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

ATTACHMENT = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)
RAW_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("length", T.LongType())])
DOCUMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("attachment", ATTACHMENT),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
PROVENANCE = T.StructType([T.StructField("id", T.LongType()), T.StructField("original_filename", T.StringType(), False), T.StructField("sha256", T.StringType(), False)])
LINK = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("path", T.StringType())])
LOG = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("ms", T.LongType()),
    ]
)
STAGES = ["setup", "downloader_up", "added_urls", "running", "downloaded", "extract", "unpack", "extracted_done", "ingest_done"]
