"""Expressions on paths, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A well-formed content hash; ``\\z`` so that a final line end doesn't pass.
HASH = r"^[a-f0-9]{64}\z"
#: Names that steer the pipeline and are no data.
CONTROL_NAMES = r"^(\.gitignore|unpack|done|running|added_urls)$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def has_extension(name: Column) -> Column:
    """A base name that doesn't begin with a dot and has one."""
    return name.rlike(r"^[^.]+\.")


def last_extension(name: Column) -> Column:
    """What follows the last dot; '' for a name that ends with one."""
    return F.regexp_replace(name, r"^.*\.", "")


def suffix(path: Column) -> Column:
    """The last extension with its dot; '' where there is none, and for dot-files."""
    return F.regexp_extract(basename(path), r"[^/](\.[^./]+)$", 1)


def content_address(sha256: Column, path: Column) -> Column:
    """Place of a content below two levels of its hash's first letters."""
    return F.concat_ws("/", F.substring(sha256, 1, 1), F.substring(sha256, 2, 1), F.concat(sha256, suffix(path)))


def served_name(sha256: Column, path: Column) -> Column:
    return F.concat(sha256, F.lower(suffix(path)))


def valid_hash(sha256: Column) -> Column:
    return F.coalesce(sha256.rlike(HASH), F.lit(False))


def strip_everywhere(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def delimited_field(line: Column, delimiter: str, n: int) -> Column:
    """The n-th field of a line; the whole line where the delimiter doesn't occur."""
    return F.when(line.contains(delimiter), F.split_part(line, F.lit(delimiter), F.lit(n))).otherwise(line)


def list_name(url: Column, lead: str) -> Column:
    """Name of a list from an address: without all that the lead matches at its begin, and without slashes."""
    return F.translate(F.regexp_replace(url, lead, ""), "/", "")


def padded(text: Column, width: int) -> Column:
    """Left-justified; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def contained(path: str, root: str) -> bool:
    """Whether a path, normalised, lies below a root."""
    import os

    full = os.path.normpath(os.path.join(root, path))
    return full == os.path.normpath(root) or full.startswith(os.path.normpath(root) + os.sep)
