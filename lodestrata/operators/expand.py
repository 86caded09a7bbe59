"""Archives expanded into a tree, each member checked."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.paths import contained

MEMBER = "archive string, path string, depth int, length long, content binary, outcome string"


@dataclass(frozen=True)
class Bounds:
    """What an archive may grow to; beyond it members are named with an outcome, not expanded."""

    depth: int = 5
    member: int = 300 << 20
    total: int = 2 << 30
    password: str | None = None


def _members(name: str, data: bytes, bounds: Bounds, password: str | None = None) -> Iterator[tuple[str, bytes | None, str]]:
    low = name.lower()
    try:
        if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    if i.file_size > bounds.member:
                        yield i.filename, None, "too large"
                        continue
                    with z.open(i, pwd=password.encode() if password else None) as f:
                        got = f.read(bounds.member + 1)
                    yield (i.filename, got, "ok") if len(got) <= bounds.member else (i.filename, None, "too large")
            return
        opened = {b"\x1f\x8b": gzip.open, b"BZ": bz2.open, b"\xfd7": lzma.open}.get(data[:2])
        if opened:
            with opened(io.BytesIO(data)) as f:
                inner = f.read(bounds.member + 1)
            if len(inner) > bounds.member:
                yield name, None, "too large"
                return
            if _is_tar(inner):
                yield from _members(name + ".tar", inner, bounds)
            else:
                stem = name.rsplit("/", 1)[-1]
                yield stem.rsplit(".", 1)[0] if "." in stem else stem, inner, "ok"
            return
        if _is_tar(data) or low.endswith(".tar"):
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if not m.isfile():
                        continue
                    if m.size > bounds.member:
                        yield m.name, None, "too large"
                    else:
                        yield m.name, t.extractfile(m).read(), "ok"
            return
        yield name, None, "unsupported"
    except (OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zipfile.LargeZipFile, ValueError) as e:
        yield name, None, f"error: {type(e).__name__}"


def _is_tar(data: bytes) -> bool:
    return data[257:262] == b"ustar"


def is_archive(data: bytes) -> bool:
    return data[:4] in (b"PK\x03\x04", b"PK\x05\x06") and b"[Content_Types].xml" not in data[:4096] and not data[30:38] == b"mimetype" or data[:2] in (b"\x1f\x8b", b"BZ") or data[:6] == b"\xfd7zXZ\x00" or _is_tar(data)


def expand(name: str, data: bytes, bounds: Bounds = Bounds()) -> Iterator[tuple[str, int, bytes | None, str]]:
    """(path, depth, content, outcome) of all members, archives within archives expanded as well; the password is for the outermost."""
    spent = 0
    todo = [(name, data, "", 1)]
    while todo:
        n, d, lead, depth = todo.pop()
        for path, content, outcome in _members(n, d, bounds, bounds.password if depth == 1 else None):
            at = f"{lead}{path}"
            if not contained(path, "/x") or path.startswith("/"):
                yield at, depth, None, "outside"
                continue
            if content is None:
                yield at, depth, None, outcome
                continue
            spent += len(content)
            if spent > bounds.total:
                yield at, depth, None, "too large"
                return
            if is_archive(content):
                if depth >= bounds.depth:
                    yield at, depth, None, "too deep"
                else:
                    todo.append((path, content, f"{at}/", depth + 1))
                continue
            yield at, depth, content, outcome


#: Members and bytes of a batch.
ROWS, BYTES = 1000, 64 << 20


def expanded(archives: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Members of the archives in (path, content) rows; an archive that can't be read gives one row with its error.
    A batch holds many small members, or few large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("length", pa.int64()), ("content", pa.binary()), ("outcome", pa.string())])
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for archive, data in zip(b.column("path"), b.column("content")):
                archive = archive.as_py()
                for path, depth, content, outcome in expand(archive.rsplit("/", 1)[-1], data.as_py() or b"", bounds):
                    rows.append((archive, path, depth, None if content is None else len(content), content, outcome))
                    held += len(content or b"")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield made()
                        rows, held = [], 0
        if rows:
            yield made()

    return archives.select("path", "content").mapInArrow(run, MEMBER)
