"""Object ids: 40 hex digits, letter case and surrounding blanks without meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The id that refers to nothing.
NULL_ID = "0" * 40


def norm_id(c: Column | str) -> Column:
    """Trimmed lower-case id; null for null, blank and the NULL id."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when((x != "") & (x != NULL_ID), x)


def id_hash(*cols: Column) -> Column:
    """64-bit hash of ids where null counts as a value of its own."""
    return F.xxhash64(*[F.coalesce(c, F.lit("")) for c in cols])


def id_key(c: Column) -> Column:
    """Exact binary form of a normalised id: 20 bytes for 40 hex digits, else a longer one holding the text."""
    raw = F.when(c.rlike("^[0-9a-f]{40}$"), F.unhex(c))
    return F.coalesce(raw, F.concat(F.lit(bytes(21)), F.encode(c, "UTF-8")))
