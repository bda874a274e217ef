"""Edits between two versions of a geometry, by the longest common subsequence of their coordinates."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = re.compile(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)")
EDITS = "deleted int, inserted int, moved int"


def edits(old: str | None, new: str | None) -> tuple[int, int, int]:
    """Coordinates deleted, inserted and moved (replaced one for one) from ``old`` to ``new``; null has none."""
    a, b = _PAIR.findall(old or ""), _PAIR.findall(new or "")
    deleted = inserted = moved = 0
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            same = min(j - i, m - k)
            moved, deleted, inserted = moved + same, deleted + (j - i) - same, inserted + (m - k) - same
    return deleted, inserted, moved


def merge_edits(ancestor: str, ours: str, theirs: str) -> str | None:
    """The geometry with both sides' coordinate edits, or null if they touch the same coordinates or not one kind."""
    kind = lambda w: re.split(r"[\s(]", w.strip(), maxsplit=1)[0].upper()
    if len({kind(w) for w in (ancestor, ours, theirs)}) > 1 or ancestor.count("(") > 2:
        return None
    base = _PAIR.findall(ancestor)
    changes = []
    for w in (ours, theirs):
        other = _PAIR.findall(w)
        ops = difflib.SequenceMatcher(None, base, other, autojunk=False).get_opcodes()
        changes += [(i, j, other[k:m]) for op, i, j, k, m in ops if op != "equal"]
    out, at = [], 0
    for i, j, put in sorted(changes, key=lambda c: (c[0], c[1])):
        if i < at:
            return None
        out += base[at:i] + put
        at = j
    out += base[at:]
    depth = ancestor.count("(")
    return f"{kind(ancestor)} {'(' * depth}{', '.join(' '.join(p) for p in out)}{')' * depth}"


def geometry_edits(old: Column, new: Column) -> Column:
    """Struct ``deleted inserted moved`` of two columns of well-known text."""

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [edits(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["deleted", "inserted", "moved"], dtype="int32")

    return run(old, new)
