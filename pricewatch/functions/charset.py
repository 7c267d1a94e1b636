"""Text of archived pages that were stored as bytes."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_HEADER = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)
_META = re.compile(rb"<meta[^>]{0,512}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Bytes of a page in which its own declaration is looked for.
DECLARED_WITHIN = 4096
#: What UTF-8 read as Latin-1 shows.
DAMAGE = "Ã"


def _known(name: str | None) -> str | None:
    try:
        return codecs.lookup(name).name if name else None
    except LookupError:
        return None


def _as_utf8(content: bytes) -> str | None:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return None


def page_text(content: bytes, content_type: str | None) -> str:
    """Text of one page: by the charset of its header, else by its byte order mark, else as UTF-8 if it is that, else by its meta
    declaration, else as Latin-1. Text by the header that looks like UTF-8 read as Latin-1 is read as UTF-8 if that mends it."""
    found = _HEADER.search(content_type or "")
    header = _known(found.group(1) if found else None)
    if header:
        text = content.decode(header, errors="replace")
        utf8 = _as_utf8(content) if DAMAGE in text else None
        return utf8 if utf8 is not None and (DAMAGE not in utf8 or header == "iso8859-1") else text
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark):].decode(name, errors="replace")
    utf8 = _as_utf8(content)
    if utf8 is not None:
        return utf8
    declared = _META.search(content[:DECLARED_WITHIN])
    return content.decode(_known(declared.group(1).decode("ascii") if declared else None) or "latin-1", errors="replace")


def _decoded(content: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else page_text(bytes(c), t) for c, t in zip(content, content_type)], dtype=object)


def decode_page(content: Column, content_type: Column | None = None) -> Column:
    """Text of a page from its bytes and its content-type header; null bytes stay null."""
    decoded = F.pandas_udf(_decoded, StringType())
    return decoded(content, (F.lit(None) if content_type is None else content_type).cast("string"))
