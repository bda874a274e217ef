"""Differences between two sets of listings: a full outer join on the path, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bounds, paths, values
from ..workspace import materialize
from .listing import subtree_stats
from .snapshots import PATH

SIDE = ["ref_type", "object_id", "metadata_id", *bounds.BOUNDS]


def diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None, change: str | None = None, trees: bool = False) -> DataFrame:
    """``keys parent_path ref_name change_kind old_* new_*`` of paths that differ.

    ``old`` and ``new`` are listings, ``keys`` columns that pair their snapshots (none: one snapshot each).
    ADDED and REMOVED have one side; MODIFIED paths have another object id (metadata ids and bounds don't
    count, null equals null). ``change`` asks for one kind only. ``trees`` also reports TREE rows. Null path
    parts are values like any other. Both sides are laid over one another and each path's at most two rows
    compared by one window, so one shuffle serves listings and difference.
    """
    at = [*(keys or []), *PATH]
    if not trees:
        old, new = old.filter("ref_type = 'FEATURE'"), new.filter("ref_type = 'FEATURE'")
    both = old.select(*at, *SIDE, F.lit(0).alias("_side")).unionByName(new.select(*at, *SIDE, F.lit(1).alias("_side")))
    w = Window.partitionBy(*at).orderBy("_side")
    rows = both.withColumns({"_before": F.lag(F.struct(*SIDE)).over(w), "_after": F.lead("_side").over(w)})
    is_new, before = F.col("_side") == 1, F.col("_before")
    kind = (
        F.when(~is_new & F.col("_after").isNull(), "REMOVED").when(is_new & before.isNull(), "ADDED")
        .when(is_new & ~before["object_id"].eqNullSafe(F.col("object_id")), "MODIFIED")
    )
    rows = rows.withColumn("change_kind", kind).filter(F.col("change_kind") == change if change else F.col("change_kind").isNotNull())
    return rows.select(
        *at, "change_kind", *[F.when(is_new, before[c]).otherwise(F.col(c)).alias("old_" + c) for c in SIDE], *[F.when(is_new, F.col(c)).alias("new_" + c) for c in SIDE]
    )


def pruned_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`diff` of features that first drops parent paths whose digests are the same on both sides."""
    a, b = subtree_stats(old, keys), subtree_stats(new, keys)
    at = [*keys, "parent_path"]
    rename = lambda d, p: d.select(*[F.col(c).alias(p + c) for c in at], F.col("digest").alias(p + "digest"), F.col("n_rows").alias(p + "n"))
    both = rename(a, "o_").join(rename(b, "n_"), [F.col("o_" + c).eqNullSafe(F.col("n_" + c)) for c in at])
    same = both.filter("o_digest = n_digest and o_n = n_n").select(*[F.col("o_" + c).alias("s_" + c) for c in at])
    keep = lambda d: d.join(same, [d[c].eqNullSafe(same["s_" + c]) for c in at], "left_anti")
    return diff(keep(old), keep(new), keys)


def filter_path(changes: DataFrame, path: str) -> DataFrame:
    """Changes at or below a path; trees also if they are above it."""
    is_tree = F.coalesce("new_ref_type", "old_ref_type") == "TREE"
    return changes.filter(paths.applies(paths.full_path("parent_path", "ref_name"), is_tree, path))


def filter_bounds(changes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Changes whose old or new bounds meet the box."""
    return changes.filter(bounds.intersects(box, "old_") | bounds.intersects(box, "new_"))


def count_changes(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row (for each key): features and trees added, modified and removed."""
    is_tree = F.coalesce("new_ref_type", "old_ref_type") == "TREE"
    n = lambda tree, kind: F.count(F.when((is_tree if tree else ~is_tree) & (F.col("change_kind") == kind), 1))
    kinds = ("ADDED", "MODIFIED", "REMOVED")
    return changes.groupBy(*(keys or [])).agg(
        *[n(False, k).alias("features_" + k.lower()) for k in kinds], *[n(True, k).alias("trees_" + k.lower()) for k in kinds]
    )


def count_rollup(changes: DataFrame, outer: str) -> DataFrame:
    """Counts by ``outer``, parent path and kind with subtotals; ``level`` tells what a row totals."""
    return (
        changes.rollup(outer, "parent_path", "change_kind")
        .agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
        .select(outer, "parent_path", "change_kind", "level", "n")
    )


def diff_bounds(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bounds of the old sides, the new sides and of both, of changes whose bounds differ."""
    moved = changes.filter(~bounds.same("old_", "new_"))
    sides = moved.groupBy(*(keys or [])).agg(*bounds.envelope("old_", "old_"), *bounds.envelope("new_", "new_"))
    return sides.select("*", *bounds.merged("old_", "new_", "both_"))


def renames(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys object_id old_path new_path``: objects under one path before and another, new path after.

    Removed and added paths are paired by object id where the object left and came exactly once in a
    snapshot pair, so an object at many paths doesn't multiply.
    """
    once = lambda d, side: (
        d.select(*keys, F.col(f"{side}_object_id").alias("object_id"), paths.full_path("parent_path", "ref_name").alias("path"))
        .filter("object_id is not null").groupBy(*keys, "object_id").agg(F.count("*").alias("n"), F.min("path").alias(f"{side}_path"))
        .filter("n = 1").drop("n")
    )
    return once(diff(old, new, keys, "REMOVED"), "old").join(once(diff(old, new, keys, "ADDED"), "new"), [*keys, "object_id"])


def moves(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys object_id side path``: every path that an object left (``old``) or came to (``new``), of objects that did both.

    All pairings of :func:`renames` and those of objects at several paths, as memberships: nothing is multiplied.
    """
    ends = diff(old, new, keys).filter("change_kind <> 'MODIFIED'").select(
        *keys, F.coalesce("old_object_id", "new_object_id").alias("object_id"), F.when(F.col("change_kind") == "REMOVED", "old").otherwise("new").alias("side"),
        paths.full_path("parent_path", "ref_name").alias("path"),
    )
    ends = materialize(ends.filter("object_id is not null"))
    both = ends.groupBy(*keys, "object_id").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a <> b").drop("a", "b")
    return ends.join(both, [*keys, "object_id"], "left_semi")


def type_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Trees whose feature type differs: ``keys path old_metadata_id new_metadata_id``."""
    t = lambda d, side: d.filter("ref_type = 'TREE'").select(
        *keys, paths.full_path("parent_path", "ref_name").alias("path"), F.col("metadata_id").alias(f"{side}_metadata_id")
    )
    return t(old, "old").join(t(new, "new"), [*keys, "path"]).filter(~F.col("old_metadata_id").eqNullSafe(F.col("new_metadata_id")))


def attribute_diff(changes: DataFrame, texts: DataFrame, keys: list[str], unchanged: bool = False) -> DataFrame:
    """``keys parent_path ref_name pos old_kind old_value new_kind new_value change``: changes by attribute.

    ``texts`` has ``object_id`` (unique) and ``object_text``; a side without text has no attributes. ``change``
    is ADDED, REMOVED, MODIFIED or, if asked for, NO_CHANGE.
    """
    one = lambda side: texts.select(F.col("object_id").alias(f"{side}_object_id"), F.col("object_text").alias(f"_{side}"))
    full = changes.join(one("old"), "old_object_id", "left").join(one("new"), "new_object_id", "left")
    none = F.array().cast("array<struct<pos:int,kind:string,value:string>>")
    a, b = (F.coalesce(values.attributes(f"_{s}"), none) for s in ("old", "new"))
    at = F.posexplode(F.arrays_zip(a.alias("o"), b.alias("n"))).alias("pos", "x")
    rows = full.select(*keys, *PATH, at).select(
        *keys, *PATH, "pos", F.col("x.o.kind").alias("old_kind"), F.col("x.o.value").alias("old_value"),
        F.col("x.n.kind").alias("new_kind"), F.col("x.n.value").alias("new_value"),
    )
    same = F.col("old_kind").eqNullSafe(F.col("new_kind")) & F.col("old_value").eqNullSafe(F.col("new_value"))
    kind = F.when(F.col("old_kind").isNull(), "ADDED").when(F.col("new_kind").isNull(), "REMOVED").when(same, "NO_CHANGE").otherwise("MODIFIED")
    out = rows.withColumn("change", kind)
    return out if unchanged else out.filter("change <> 'NO_CHANGE'")
