"""What queries need besides tables, written once for a session in the shared folder: trees of files, archives, indices."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources import store
from lodestrata.sources.lines import table

_KNOWN: dict[tuple[str, str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder of this session, on a file system that is mounted everywhere; it is removed at the end."""
    where = f"{store.mounted(store.shared_dir(spark)).rstrip('/')}/made/{uuid.uuid4().hex}"
    store.remove_at_end(spark, where)
    return where


def once(spark: SparkSession, data: str, name: str) -> str:
    """The folder of a name for the tables of a folder, the same one as long as the session lasts; of any file system."""
    key = (spark.sparkContext.applicationId, data, name)
    if key not in _KNOWN:
        _KNOWN[key] = f"{store.shared_dir(spark).rstrip('/')}/made/{uuid.uuid4().hex}"
        store.remove_at_end(spark, _KNOWN[key])
    return _KNOWN[key]


def tree(spark: SparkSession, data: str, zipped: bool = False) -> str:
    """The contents of the index as files, some with names that begin with a dot; or each in an archive beside an inner archive."""
    where = store.mounted(once(spark, data, "archives" if zipped else "files"))
    if not os.path.exists(f"{where}.done"):
        rows = table(spark, data, "leakdata_index").where("attachment.content <> ''").select("seq_no", F.col("attachment.content_type").alias("kind"), "attachment.content")
        _write(rows, where, zipped).count()
        with open(f"{where}.done", "w"):
            pass
    return where


def _write(rows: DataFrame, where: str, zipped: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                at = f"{where}/{n % 64}"
                os.makedirs(at, exist_ok=True)
                name, data = f"{'.' if kind is None else ''}{n}.txt", text.encode()
                if zipped:
                    name, data = f"{n}.zip", _zip({f"text/{n}.txt": data, "inner.zip": _zip({"kind.txt": (kind or "").encode()})})
                part = f"{at}/{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["seq_no"])

    return rows.mapInArrow(run, "seq_no long")


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()
