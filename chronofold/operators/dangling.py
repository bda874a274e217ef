"""References to records that do not exist: bitmaps of references AND-NOT bitmaps of what they may refer to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_key, norm_id
from ..workspace import materialize

#: Integer keys of one bitmap: its offsets are unsigned 16-bit numbers.
RANGE_BITS = 16
#: Offsets up to which a bitmap is stored as their list, which is then the smaller form.
SPARSE = 4096


def pack(offsets: np.ndarray) -> bytes:
    """Compressed bitmap of distinct 16-bit offsets: their sorted list, or the bits where that is smaller."""
    offsets = np.sort(np.asarray(offsets)).astype(np.uint16)
    if len(offsets) <= SPARSE:
        return b"L" + offsets.tobytes()
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[offsets] = True
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """Sorted offsets of :func:`pack`."""
    if packed[:1] == b"L":
        return np.frombuffer(packed, np.uint16, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little")).astype(np.uint16)


def _packed(lists: pd.Series) -> pd.Series:
    return lists.map(pack)


def bitmaps(coded: DataFrame, by: list[str]) -> DataFrame:
    """``key_range``, the columns ``by`` and ``bits``: one compressed bitmap of ``code`` for each key range and ``by``.

    The sets are built by partial aggregation, so repeats of a hot key stay in the map tasks, and none
    has more than 65,536 members.
    """
    as_bits = F.pandas_udf(_packed, "binary")
    offset = F.expr(f"cast(code & {(1 << RANGE_BITS) - 1} as int)")
    return (
        coded.groupBy(F.shiftright("code", RANGE_BITS).alias("key_range"), *by)
        .agg(F.collect_set(offset).alias("offsets"))
        .select("key_range", *by, as_bits("offsets").alias("bits"))
    )


def unanswered(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``code period ref_field status`` of references left over by the bitmaps of what they may refer to.

    ``references`` are :func:`bitmaps` by period and ref_field, ``parents`` by ``state`` (``base``, ``alive`` or
    ``deleted``) and the period from which the keys exist. A reference AND NOT all parents is ``missing``; AND NOT base
    and alive ones it is ``deleted``; what is left AND NOT the parents of the reference's own and earlier periods is
    ``late``; and those that a parent of the same period answers are ``same``, to be told by their times. References of
    unknown period (-1) are never late. A key range's bitmaps meet in one task: a few for each period, 8 KB at most each.
    """
    columns = {"code": "int64", "period": "int32", "ref_field": "object", "status": "object"}

    def work(refs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        there = {s: np.zeros(1 << RANGE_BITS, bool) for s in ("base", "alive", "deleted")}
        for state, packed in zip(known["state"], known["bits"]):
            there[state][unpack(packed)] = True
        sound = there["base"] | there["alive"]
        alive = known[known["state"] == "alive"].sort_values("period")
        since, bits, at = alive["period"].to_numpy(), alive["bits"].tolist(), 0
        before, out = there["base"].copy(), []
        for period, group in refs.groupby("period", sort=True):
            while at < len(since) and since[at] < period:
                before[unpack(bits[at])] = True
                at += 1
            now = before.copy()
            if at < len(since) and since[at] == period:
                now[unpack(bits[at])] = True
            for field, packed, key_range in zip(group["ref_field"], group["bits"], group["key_range"]):
                offsets = unpack(packed)
                gone = there["deleted"][offsets] & ~sound[offsets]
                left = {"missing": offsets[~sound[offsets] & ~gone], "deleted": offsets[gone]}
                if period >= 0:
                    left["late"] = offsets[sound[offsets] & ~now[offsets]]
                    left["same"] = offsets[now[offsets] & ~before[offsets]]
                for status, rest in left.items():
                    out.append(pd.DataFrame({"code": rest.astype(np.int64) + (key_range << RANGE_BITS), "period": period, "ref_field": field, "status": status}))
        return pd.concat(out).astype(columns) if out else pd.DataFrame({c: [] for c in columns}).astype(columns)

    schema = "code long, period int, ref_field string, status string"
    return references.groupBy("key_range").cogroup(parents.groupBy("key_range")).applyInPandas(work, schema)


def commit_references(commits: DataFrame) -> DataFrame:
    """``commit_id ref_field ref_id received``: distinct references of commits; ``received`` is the commit's first receipt."""
    one = lambda field, ref: F.struct(F.lit(field).alias("ref_field"), norm_id(ref).alias("ref_id"))
    refs = F.concat(
        F.array(one("tree", F.col("tree"))),
        F.coalesce(F.transform("parents", lambda p: one("parents", p)), F.array().cast("array<struct<ref_field:string,ref_id:string>>")),
    )
    return (
        commits.select(norm_id("commit_id").alias("commit_id"), refs.alias("refs"), "received_at")
        .filter("commit_id is not null")
        .groupBy("commit_id")
        .agg(F.array_distinct(F.flatten(F.collect_set("refs"))).alias("refs"), F.min("received_at").alias("received"))
        .select("commit_id", F.explode("refs").alias("r"), "received")
        .select("commit_id", "r.ref_field", "r.ref_id", "received")
        .filter("ref_id is not null")
    )


def _month(ts: Column) -> Column:
    """Months since year 0; an unknown time is before all others."""
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(-1)).cast("int")


def dangling_references(commits: DataFrame, objects: DataFrame, base: DataFrame, deletions: DataFrame) -> DataFrame:
    """``commit_id ref_field ref_id status period``: references of commits to objects not there.

    ``missing``: never put; ``deleted``: last deletion after the last receipt of a put; ``late``: first
    receipt of a put after the commit's first receipt. Keys in ``base`` are always there. ``period`` is the
    month (``yyyy-mm``) of the commit's first receipt.

    All keys get integers; references become compressed bitmaps for each key range, month and field, and objects
    for each key range, state and month from which they exist. AND NOT tells the status of every reference but
    of those whose object came in the same month as the commit (:func:`unanswered`); only for these are times
    looked up, and surviving bits are decoded by joining them to the coded references. Null ids refer to nothing, null lists are empty, puts and deletions
    without time count as put and as not deleted; empty tables give what the definition says.
    """
    none = F.lit(None).cast("timestamp")
    refs = materialize(commit_references(commits).withColumn("key", id_key(F.col("ref_id"))))
    put = objects.select(norm_id("id").alias("id"), F.col("received_at").alias("put"), none.alias("deleted"), F.lit(True).alias("stored"), F.lit(False).alias("base"))
    old = base.select(norm_id("id").alias("id"), none.alias("put"), none.alias("deleted"), F.lit(True).alias("stored"), F.lit(True).alias("base"))
    gone = deletions.select(norm_id("id").alias("id"), none.alias("put"), F.col("deleted_at").alias("deleted"), F.lit(False).alias("stored"), F.lit(False).alias("base"))
    known = put.unionByName(old).unionByName(gone).filter("id is not null").select(id_key(F.col("id")).alias("key"), "put", "deleted", "stored", "base")
    named = refs.select("key", none.alias("put"), none.alias("deleted"), F.lit(False).alias("stored"), F.lit(False).alias("base"))
    dead = F.coalesce(F.col("last_deleted") > F.col("last_put"), F.lit(False))
    keys = materialize(
        known.unionByName(named)
        .groupBy("key")
        .agg(F.min("put").alias("first_put"), F.max("put").alias("last_put"), F.max("deleted").alias("last_deleted"), F.max("stored").alias("stored"), F.max("base").alias("base"))
        .select(
            F.monotonically_increasing_id().alias("code"), "key", "first_put",
            F.when(F.col("base"), "base").when(F.col("stored"), F.when(dead, "deleted").otherwise("alive")).alias("state"),
        )
    )
    coded = materialize(
        refs.join(keys.select("key", "code"), "key").select("commit_id", "ref_field", "ref_id", "received", "code", _month(F.col("received")).alias("period"))
    )
    since = F.when(F.col("state") == "alive", _month(F.col("first_put"))).otherwise(F.lit(-2))
    parents = bitmaps(keys.filter("state is not null").select("code", "state", since.alias("period")), ["state", "period"])
    left = materialize(unanswered(bitmaps(coded.select("code", "period", "ref_field"), ["period", "ref_field"]), parents))
    open_ = coded.join(left, ["code", "period", "ref_field"])
    names = ["commit_id", "ref_field", "ref_id"]
    by_time = open_.filter("status = 'same'").join(keys.select("code", "first_put"), "code").filter("first_put > received")
    told = open_.filter("status <> 'same'").select(*names, "status", "received").unionByName(by_time.select(*names, F.lit("late").alias("status"), "received"))
    return told.select(*names, "status", F.date_format("received", "yyyy-MM").alias("period"))


def dangling_counts(found: DataFrame) -> DataFrame:
    """``ref_field period status n_refs n_ids``: counts of :func:`dangling_references` per field and period."""
    return found.groupBy("ref_field", "period", "status").agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_ids")
    )
