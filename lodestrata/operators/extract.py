"""Text and title of a content, by its media type; a registry that callers can add to."""

from __future__ import annotations

import email
import email.policy
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import markup

#: Longest text that is kept, in characters.
LONGEST = 200_000
Extractor = Callable[[bytes], tuple[str, str | None]]


def decode(data: bytes) -> str:
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def from_text(data: bytes) -> tuple[str, str | None]:
    return decode(data), None


def from_html(data: bytes) -> tuple[str, str | None]:
    page = decode(data)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    body = re.sub(r"(?is)<(script|style|title)[^>]*>.*?</\1>", " ", page)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]*>", " ", body))).strip(), html.unescape(title.group(1)).strip() if title else None


def from_mail(data: bytes) -> tuple[str, str | None]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    text = part.get_content() if part else ""
    if part and part.get_content_subtype() == "html":
        text = from_html(text.encode())[0]
    return text.strip(), m.get("subject")


#: Bytes that a part of an office file may have once it is unpacked, and all parts together.
PART, PARTS = 64 << 20, 256 << 20


def _parts(z: zipfile.ZipFile) -> Callable[[str], bytes]:
    """Reads parts of an archive within bounds, whatever sizes it names."""
    left = PARTS

    def read(name: str) -> bytes:
        nonlocal left
        with z.open(name) as f:
            got = f.read(min(PART, left) + 1)
        left -= len(got)
        if len(got) > PART or left < 0:
            raise ValueError("too large")
        if b"<!ENTITY" in got[:4096]:
            raise ValueError("entities")
        return got

    return read


def office_type(data: bytes) -> str:
    """Media type of a zipped office file by its parts; that of an archive for any other."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if "mimetype" in names:
                return _parts(z)("mimetype").decode("ascii", "replace").strip()
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile):
        return "application/zip"
    for lead, kind in (("word/", "wordprocessingml.document"), ("xl/", "spreadsheetml.sheet"), ("ppt/", "presentationml.presentation")):
        if any(n.startswith(lead) for n in names):
            return f"application/vnd.openxmlformats-officedocument.{kind}"
    return "application/zip"


def from_rtf(data: bytes) -> tuple[str, str | None]:
    """Text of a rich text file: without groups that hold no text, its control words and escapes."""
    t = data.decode("latin-1")
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), t)
    t = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), t)
    out, skip, depth = [], 0, 0
    for m in re.finditer(r"([{}])|\\(\*|[a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([^{}\\]+)", t):
        if m[1] == "{":
            depth += 1
        elif m[1]:
            depth -= 1
            skip = 0 if depth < skip else skip
        elif m[2] in ("*", "fonttbl", "colortbl", "stylesheet", "info", "pict"):
            skip = skip or depth
        elif not skip:
            out.append("\n" if m[2] in ("par", "line", "row") else "\t" if m[2] in ("tab", "cell") else m[4] or (m[5] or "").replace("\r", "").replace("\n", "") if not m[2] else "")
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip(), None


def from_office(data: bytes) -> tuple[str, str | None]:
    """Text of the XML parts of a zipped office file, its runs joined and paragraphs on lines."""
    out, title = [], None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = _parts(z)
        for n in z.namelist():
            if re.search(r"(word/document|content|xl/sharedStrings|ppt/slides/slide\d+)\.xml$", n):
                lines: list[str] = []
                for e in ElementTree.fromstring(read(n)).iter():
                    tag = e.tag.rsplit("}", 1)[-1]
                    if tag in ("p", "si", "h"):
                        lines.append("")
                    if e.text and tag in ("t", "p", "h", "span", "a"):
                        lines[-1:] = [(lines[-1] if lines else "") + e.text]
                out += lines
            elif n == "docProps/core.xml":
                title = next((e.text for e in ElementTree.fromstring(read(n)).iter() if e.tag.endswith("}title")), None)
    return "\n".join(x for x in out if x).strip(), title


#: Media types of zipped office files.
OFFICE = [
    "openxmlformats-officedocument.wordprocessingml.document", "openxmlformats-officedocument.spreadsheetml.sheet", "openxmlformats-officedocument.presentationml.presentation",
    "oasis.opendocument.text", "oasis.opendocument.spreadsheet", "oasis.opendocument.presentation",
]
REGISTRY: dict[str, Extractor] = {
    "text/plain": from_text, "text/csv": from_text, "text/xml": from_text, "application/json": from_text, "text/html": from_html, "message/rfc822": from_mail, "text/rtf": from_rtf,
} | {f"application/vnd.{x}": from_office for x in OFFICE}


def extracted(files: DataFrame, registry: dict[str, Extractor] | None = None) -> DataFrame:
    """With content_type and an attachment; a content that can't be read keeps an empty text and says why in message.

    Put it after the choice of one row per hash, so that each distinct content is read once.
    """
    known = registry or REGISTRY
    columns = [c for c in files.columns if c != "content"]
    typed = files.withColumn("content_type", F.when(F.col("content").isNotNull(), markup.sniff(F.col("content"))))

    def one(kind: str | None, data: bytes | None) -> tuple[str, str | None, str]:
        if data is None:
            return "", None, "too large"
        if not data:
            return "", None, "ok"
        if kind not in known:
            return "", None, "error: BadZipFile" if kind == "application/zip" and not zipfile.is_zipfile(io.BytesIO(data)) else "unsupported"
        try:
            text, title = known[kind](data)
            return text[:LONGEST], title, "ok"
        except Exception as e:  # any file may be damaged in any way
            return "", None, f"error: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, data = b.column("content_type").to_pylist(), b.column("content").to_pylist()
            kinds = [office_type(d) if k == "application/zip" else k for k, d in zip(kinds, data)]
            got = [one(k, d) for k, d in zip(kinds, data)]
            own = [b.column(c) for c in columns] + [pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([g[i] for g in got], pa.string()) for i in range(3))], names=[*columns, "content_type", "text", "title", "message"])

    kinds = dict(files.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", content_type string, text string, title string, message string"
    return typed.mapInArrow(run, schema)
