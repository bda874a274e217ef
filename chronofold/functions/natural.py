"""Natural order of names: a 64-bit hash of their UTF-16 bytes, compared unsigned, and the tree bucket it gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 64-bit Fowler-Noll-Vo hash. Fixed values.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Buckets of a tree node, and its depth. Fixed values.
BUCKETS, MAX_DEPTH = 32, 8


def fnv64(names: pd.Series) -> np.ndarray:
    """Hashes of names; each byte enters with its sign, as the established order has it."""
    raw = [n.encode("utf-16-be", "surrogatepass") for n in names]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.full(len(raw), OFFSET, np.uint64)
    width = int(lens.max()) if len(raw) else 0
    table = np.zeros((len(raw), width), np.int8)
    for i, r in enumerate(raw):
        table[i, : len(r)] = np.frombuffer(r, np.int8)
    for k in range(width):
        on = lens > k
        out[on] = (out[on] ^ table[on, k].astype(np.int64).view(np.uint64)) * np.uint64(PRIME)
    return out


def natural_key(name: Column | str) -> Column:
    """Sixteen hex digits that sort in natural order; null for null."""

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(names), index=names.index, dtype=object)
        some = names.notna()
        out[some] = [f"{h:016x}" for h in fnv64(names[some])]
        return out

    return key(F.col(name) if isinstance(name, str) else name)


def bucket(key: Column, depth: int) -> Column:
    """Bucket at a depth below :data:`MAX_DEPTH`, from :func:`natural_key`."""
    byte = F.conv(F.substring(key, 2 * depth + 1, 2), 16, 10).cast("int")
    return F.floor(byte * BUCKETS / 256).cast("int")
