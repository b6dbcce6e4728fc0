"""Bytes to text: a byte order mark, a declared encoding, strict UTF-8, Windows-1252."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of_bytes(data: bytes) -> str:
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    head = data[:1024].decode("latin-1")
    m = re.search(r"encoding\s*=\s*[\"']([\w-]+)[\"']", head, re.I) or re.search(r"charset\s*=\s*[\"']?([\w-]+)", head, re.I)
    if m and not re.fullmatch("utf-?8", m[1], re.I):
        try:
            return data.decode(m[1], "replace")
        except LookupError:
            pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def text_of_utf8(data: Column) -> Column:
    """The fast path inside Catalyst: valid UTF-8 without a mark or declaration; null where text_of_bytes must look."""
    return F.when(F.is_valid_utf8(data.cast("string")) & ~data.cast("string").startswith("﻿") & ~F.substring(data.cast("string"), 1, 1024).rlike(r"(?i)(encoding|charset)\s*="), data.cast("string"))
