"""Tags as text: ``key:value`` joined by bars, split at the last colon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column | str) -> Column:
    """``map<string,string>``; tokens without a colon are skipped, of a repeated key the last counts; null gives an empty map."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda t: F.contains(t, F.lit(":")))
    pair = lambda t: F.struct(
        F.regexp_extract(t, r"(?s)^(.*):[^:]*$", 1).alias("key"), F.substring_index(t, ":", -1).alias("value")
    )
    pairs = F.transform(tokens, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def encode(tags: Column | str) -> Column:
    """Text of a map, keys in order; null for null."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    entries = F.array_sort(F.map_entries(tags))
    return F.when(tags.isNotNull(), F.concat_ws("|", F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))))
