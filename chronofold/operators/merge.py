"""Three-way merge: both sides' differences from the ancestor, joined on the path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.geometry import merge_edits
from ..functions.ids import NULL_ID
from ..functions.paths import ancestor_paths, full_path
from .snapshots import PATH

#: Kinds of attributes whose edits are joined by coordinate. Fixed values.
GEOMETRIES = ["POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"]


#: The versions a merge compares, in order.
VERSIONS = ("ancestor", "ours", "theirs")


def classify(ancestor: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str] | None = None, trees: bool = False) -> DataFrame:
    """``keys parent_path ref_name merge_class ancestor ours theirs``: every path either side changed.

    ``merge_class``: ``ours`` and ``theirs`` changed on that side alone, ``same`` changed alike on both
    (also removed on both), ``both`` modified on both sides to different objects, to be merged by attribute,
    ``conflict`` otherwise: changed in different ways, or added on both sides with different objects.
    The last three columns are object ids, null where absent.

    ``trees`` adds the column ``ref_type`` and the TREE rows. What a tree holds has rows of its own, so a tree is compared
    by its feature type: its last three columns are its metadata id, or the NULL id if it has none; trees are never
    ``both``. A tree that one side removed, while the other added or modified something below it, is a
    ``conflict``. The three listings are laid over one another and compared in one shuffle.
    """
    keys = list(keys or [])
    at = [*keys, *PATH]

    def side(d: DataFrame, k: int) -> DataFrame:
        is_tree = F.col("ref_type") == "TREE"
        what = F.when(is_tree, F.coalesce("metadata_id", F.lit(NULL_ID))).otherwise(F.col("object_id"))
        return (d if trees else d.filter("ref_type = 'FEATURE'")).select(*at, F.struct("ref_type", what.alias("id")).alias("x"), F.lit(k).alias("_side"))

    every = side(ancestor, 0).unionByName(side(ours, 1)).unionByName(side(theirs, 2))
    w = Window.partitionBy(*at).orderBy("_side")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = every.withColumn("_first", F.lag("_side").over(w))
    rows = rows.withColumns({f"_{k}": F.first(F.when(F.col("_side") == k, F.col("x")), ignorenulls=True).over(whole) for k in range(3)}).filter("_first is null")
    a, o, t = (F.col(f"_{k}") for k in range(3))
    kind = lambda x: F.when(a.isNull(), F.when(x.isNotNull(), "ADDED")).when(x.isNull(), "REMOVED").when(~x.eqNullSafe(a), "MODIFIED")
    ko, kt = kind(o), kind(t)
    is_feature = (o["ref_type"] == "FEATURE") & (t["ref_type"] == "FEATURE")
    both_modified = (ko == "MODIFIED") & (kt == "MODIFIED") & is_feature
    group = F.when(kt.isNull(), "ours").when(ko.isNull(), "theirs").when((ko == kt) & o.eqNullSafe(t), "same").when(both_modified, "both").otherwise("conflict")
    out = rows.filter(ko.isNotNull() | kt.isNotNull()).select(
        *at, F.coalesce(o["ref_type"], t["ref_type"], a["ref_type"]).alias("ref_type"), group.alias("merge_class"), a["id"].alias("ancestor"), o["id"].alias("ours"), t["id"].alias("theirs")
    )
    if not trees:
        return out.drop("ref_type")
    hit = subtree_conflicts(out, keys).select(*[F.col(k).alias("_hit_" + k) for k in keys], "removed").distinct()
    on = [F.col(k).eqNullSafe(F.col("_hit_" + k)) for k in keys] + [full_path("parent_path", "ref_name") == F.col("removed")]
    fought = out.filter("ref_type = 'TREE'").join(hit, on, "left")
    settled = fought.select(*at, "ref_type", F.when(F.col("removed").isNotNull(), "conflict").otherwise(F.col("merge_class")).alias("merge_class"), *VERSIONS)
    return out.filter("ref_type <> 'TREE'").unionByName(settled)


def _merged_attribute(a: Column, o: Column, t: Column) -> tuple[Column, Column]:
    """The merged attribute and whether both sides set it differently."""
    return F.when(~o.eqNullSafe(a), o).otherwise(t), ~o.eqNullSafe(a) & ~t.eqNullSafe(a) & ~o.eqNullSafe(t)


def _merged_geometries(a: Column, o: Column, t: Column) -> Column:
    """Arrays of geometries with both sides' coordinate edits, null where they can't be joined."""

    @F.pandas_udf("array<string>")
    def run(a: pd.Series, o: pd.Series, t: pd.Series) -> pd.Series:
        one = lambda x, y, z: merge_edits(x, y, z) if None not in (x, y, z) else None
        return pd.Series([[one(*w) for w in zip(*row)] if row[0] is not None else [] for row in zip(a, o, t)], dtype=object)

    return run(a, o, t)


def merge_attributes(classified: DataFrame, texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of the class ``both``: ``keys parent_path ref_name merged_text conflicting``, merged attribute by attribute.

    An attribute takes our value if we changed it, else theirs. A geometry that both changed takes the coordinate edits of
    both, if they touch different coordinates; any other attribute that both changed to different values
    conflicts, and then ours is shown. Features whose attribute counts or kinds differ between the versions
    conflict as a whole (``merged_text`` null), as do those without a text.
    """
    keys = list(keys or [])
    one = lambda side: texts.select(F.col("object_id").alias(side), F.col("object_text").alias("_" + side))
    j = classified.filter("merge_class = 'both'")
    for side in VERSIONS:
        j = j.join(one(side), side, "left")
    a, o, t = (values.attributes("_" + s) for s in VERSIONS)
    alike = (F.size("a") == F.size("o")) & (F.size("a") == F.size("t"))
    z = F.arrays_zip("a", "o", "t")
    part = lambda x: [F.struct(x[s]["kind"].alias("kind"), x[s]["value"].alias("value")) for s in ("a", "o", "t")]
    shape = lambda x: x["a"]["kind"].isin(GEOMETRIES) & (x["a"]["kind"] == x["o"]["kind"]) & (x["a"]["kind"] == x["t"]["kind"])
    fought = lambda x: _merged_attribute(*part(x))[1]
    mixed = F.exists(z, lambda x: (x["o"]["kind"] != "NULL") & (x["t"]["kind"] != "NULL") & (x["o"]["kind"] != x["t"]["kind"]))
    shapes = F.filter(z, lambda x: fought(x) & shape(x))
    text = lambda s: F.transform("shapes", lambda x: x[s]["value"])
    j = j.withColumns({"a": a, "o": o, "t": t})
    j = j.withColumns({"whole": F.coalesce(alike & ~mixed, F.lit(False))}).withColumn("shapes", F.when(F.col("whole"), shapes).otherwise(F.filter(z, lambda x: F.lit(False))))
    j = j.withColumn("joined", _merged_geometries(text("a"), text("o"), text("t")))
    j = j.withColumn("at", F.map_from_arrays(F.transform("shapes", lambda x: x["a"]["pos"]), "joined"))
    new = lambda x: F.try_element_at(F.col("at"), x["a"]["pos"])
    own = lambda x: F.when(~part(x)[1].eqNullSafe(part(x)[0]), x["o"]).otherwise(x["t"])
    merged = F.transform(z, lambda x: F.struct(own(x)["pos"].alias("pos"), own(x)["kind"].alias("kind"), F.coalesce(new(x), own(x)["value"]).alias("value")))
    clash = F.exists(z, lambda x: fought(x) & new(x).isNull())
    return j.select(
        *keys, *PATH, F.when(F.col("whole"), values.render(merged)).alias("merged_text"), (~F.col("whole") | F.coalesce(clash, F.lit(True))).alias("conflicting")
    )


def check_merge(classified: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: changed paths, those of class ``both`` and ``conflict``, and whether the merge isn't a plain union."""
    n = lambda c: F.count(F.when(F.col("merge_class") == c, 1))
    return classified.groupBy(*keys).agg(
        F.count("*").alias("n_paths"), n("both").alias("n_both"), n("conflict").alias("n_conflicts"),
        (n("both") + n("conflict") > 0).alias("would_conflict"),
    )


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    """Conflicts in text form: path, ancestor, ours and theirs, separated by tabs; the NULL id where absent."""
    ids = [F.coalesce(c, F.lit(NULL_ID)) for c in ("ancestor", "ours", "theirs")]
    return conflicts.select(F.concat_ws("\t", full_path("parent_path", "ref_name"), *ids).alias("conflict"))


def subtree_conflicts(classified: DataFrame, keys: list[str]) -> DataFrame:
    """``keys removed path``: what one side added or modified below a tree the other side removed, by an equi-join on exploded ancestor paths.

    ``classified`` has the TREE rows of :func:`classify`. One removed tree is one row of the small side, so a
    tree with any share of the changes below it is no hot key of an exploded side: its changes stay where they are.
    """
    path = full_path("parent_path", "ref_name")
    alone = classified.filter("merge_class in ('ours', 'theirs')")
    gone = alone.filter("ref_type = 'TREE' and (ours is null or theirs is null) and ancestor is not null").select(*keys, path.alias("removed"), F.col("merge_class").alias("by"))
    kept = F.when(F.col("merge_class") == "ours", F.col("ours")).otherwise(F.col("theirs")).isNotNull()
    below = alone.filter(kept & (F.coalesce("parent_path", F.lit("")) != "")).select(*keys, path.alias("path"), "merge_class", F.explode(ancestor_paths("parent_path")).alias("_above"))
    g = gone.select(*[F.col(k).alias("_gone_" + k) for k in keys], "removed", "by")
    on = [F.col(k).eqNullSafe(F.col("_gone_" + k)) for k in keys] + [F.col("_above") == F.col("removed"), F.col("merge_class") != F.col("by")]
    return below.join(g, on).select(*keys, "removed", "path")


def apply_changes(nodes: DataFrame, changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The listing after applying changes: removed and modified paths go out, added and modified ones come in.

    ``changes`` is a :func:`~chronofold.operators.diff.diff`, the paths of which need not be in ``nodes``.
    """
    from ..functions.bounds import BOUNDS

    at = [*(keys or []), *PATH]
    hit = changes.select(*[F.col(c).alias("_" + c) for c in at]).distinct()
    kept = nodes.join(hit, [nodes[c].eqNullSafe(hit["_" + c]) for c in at], "left_anti").select(*at, "ref_type", "object_id", "metadata_id", *BOUNDS)
    new = changes.filter("change_kind <> 'REMOVED'").select(*at, *[F.col("new_" + c).alias(c) for c in ("ref_type", "object_id", "metadata_id", *BOUNDS)])
    return kept.unionByName(new)


def reversed_changes(changes: DataFrame) -> DataFrame:
    """The changes that undo ``changes``: sides swapped, ADDED and REMOVED exchanged."""
    kind = F.when(F.col("change_kind") == "ADDED", "REMOVED").when(F.col("change_kind") == "REMOVED", "ADDED").otherwise(F.col("change_kind"))
    names = [("new_" + c[4:]) if c.startswith("old_") else ("old_" + c[4:]) if c.startswith("new_") else c for c in changes.columns]
    return changes.withColumn("change_kind", kind).toDF(*names).select(changes.columns)
