"""Expressions on markup and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """Text of a page: without scripts, styles and tags, its blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def base_type(content_type: Column) -> Column:
    """Media type without its parameters, in small letters; octet-stream where unknown."""
    return F.coalesce(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit("application/octet-stream"))


#: Leading bytes, in hexadecimal, and the media type they mark.
MAGIC = [
    ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("504B0506", "application/zip"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"), ("377ABCAF271C", "application/x-7z-compressed"), ("526172211A07", "application/x-rar"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383961", "image/gif"), ("474946383761", "image/gif"), ("7B5C727466", "text/rtf"), ("2142444E", "application/vnd.ms-outlook-pst"),
]


def sniff(content: Column) -> Column:
    """Media type from the leading bytes of a binary column."""
    lead = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    out = F.when(F.length(content) == 0, F.lit("inode/x-empty"))
    for mark, kind in MAGIC:
        out = out.when(lead.startswith(mark), F.lit(kind))
    return sniff_text(text, out).otherwise(F.lit("text/plain"))


def sniff_text(text: Column, out: Column | None = None) -> Column:
    """Media type from the begin of a text, in small letters."""
    cases = [
        (text.rlike(r"^\s*(<!doctype html|<html|<head|<body)"), "text/html"),
        (text.rlike(r"^\s*<\?xml"), "text/xml"),
        (text.rlike(r"^(from|return-path|received|message-id|von|de|od) ?:"), "message/rfc822"),
        (text.rlike(r"^\s*[\[{]\s*[\"\[{]"), "application/json"),
        (text.contains("\x00"), "application/octet-stream"),
    ]
    for when, kind in cases:
        out = F.when(when, F.lit(kind)) if out is None else out.when(when, F.lit(kind))
    return out


#: Media types that are sent as they are, and those that are sent so without a name.
SENT_AS_IS = ["application/octet-stream", "image/jpeg", "image/png", "image/tiff", "message/rfc822", "text/csv", "text/plain", "text/xml"]
WITHOUT_NAME = ["application/pdf", "image/jpeg", "image/png", "image/tiff", "message/rfc822", "text/csv", "text/plain", "text/xml"]
#: Media types that aren't converted.
NOT_CONVERTED = [
    "application/x-matlab-data", "application/quickbooks", "application/encrypted", "application/x-wine-extension-ini", "inode/x-empty", "application/x-ole-storage", "application/x-fpt", "application/x-ms-shortcut",
]


def route(kind: Column) -> Column:
    """How a content of a media type is shown: as it is, its page or else its document converted to PDF."""
    as_is = kind.isin(*SENT_AS_IS, *NOT_CONVERTED, "application/pdf")
    return F.when(as_is, "as_is").when(kind == "text/html", "html_to_pdf").otherwise("office_to_pdf")


def named(kind: Column) -> Column:
    """Whether a content that is shown as it is goes out under a name."""
    return ~kind.isin(WITHOUT_NAME)
