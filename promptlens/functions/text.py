"""Small text column builders (all native expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — projection constants of the ledger.
SNIPPET_CHARS = 80
SNIPPET_SUFFIX = "..."
VIEW_CHARS = 70
VIEW_SUFFIX = "…"


def snippet(text: Column, n: int = SNIPPET_CHARS, suffix: str = SNIPPET_SUFFIX) -> Column:
    """First ``n`` code points, plus ``suffix`` when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def payload_bytes(text: Column) -> Column:
    """UTF-8 length in bytes."""
    return F.octet_length(text).cast("int")


def sqlite_like_search(c: Column, search: str) -> Column:
    """``c LIKE '%search%'`` with SQLite semantics.

    ``%`` and ``_`` typed by the user stay wildcards, there is no escape character and only
    ASCII letters compare case-insensitively: what Java's ``(?is)`` without ``u`` does, so
    the column itself is searched and no payload is copied.
    """
    parts = [".*" if x == "%" else "." if x == "_" else re.sub(r"([^0-9A-Za-z\s])", r"\\\1", x) if x.isascii() else x for x in search]
    return c.rlike("(?is)" + "".join(parts))


def literal_search(c: Column, search: str) -> Column:
    """Case-insensitive literal substring (no wildcards)."""
    return F.lower(c).contains(search.lower())


def json_cell(c: Column, kind: str = "string") -> Column:
    """A CSV cell written as ``JSON.stringify(value ?? '')``.

    Strings are JSON-quoted (``to_json`` of a one-element array with the
    brackets cut off), numbers are bare, nulls become ``""``.
    """
    if kind == "string":
        quoted = F.to_json(F.array(c.cast("string")))
        return F.when(c.isNull(), F.lit('""')).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.coalesce(js_number(c), F.lit('""'))


def js_number(c: Column) -> Column:
    """A double rendered like JavaScript: integral values without '.0', no exponent."""
    d = c.cast("double")
    plain = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,9)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(plain)
