"""Listings of trees: one row a path, filtered the ways a tree is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bounds, paths
from ..functions.ids import norm_id
from ..workspace import BROADCAST_ROWS, sized_broadcast
from .snapshots import PATH

COLUMNS = ["tree", *PATH, "ref_type", "object_id", "metadata_id", *bounds.BOUNDS]
#: The ways to list a tree: direct children or any depth; features, trees or both.
STRATEGIES = {
    "CHILDREN": (False, None), "FEATURES_ONLY": (False, "FEATURE"), "TREES_ONLY": (False, "TREE"),
    "DEPTHFIRST": (True, None), "DEPTHFIRST_ONLY_FEATURES": (True, "FEATURE"), "DEPTHFIRST_ONLY_TREES": (True, "TREE"),
}


def listing(refs: DataFrame, chosen: DataFrame | None = None, n_chosen: int | None = None) -> DataFrame:
    """Root trees' listings with normalised ids, one row for each path of a tree: the one listed last.

    ``chosen`` has ``tree`` and columns that name its snapshots: only these trees are read, before anything is
    shuffled, and the result has those columns in place of ``tree``, by which and the path it is partitioned; each
    name must have one tree. ``n_chosen`` is its size, if counted. Rows without tree are left out; null path parts are
    values like any other. Equally late rows that differ are decided by type, object and metadata id and bounds,
    so the result doesn't depend on file order. Filters on the path reach the scan.
    """
    r = refs.select(
        norm_id("tree").alias("tree"), *PATH, "ref_type", norm_id("object_id").alias("object_id"),
        norm_id("metadata_id").alias("metadata_id"), *bounds.BOUNDS, "listed_at",
    ).filter("tree is not null")
    keys = ["tree"]
    if chosen is not None:
        keys = [c for c in chosen.columns if c != "tree"]
        r = r.join(sized_broadcast(chosen, BROADCAST_ROWS + 1 if n_chosen is None else n_chosen), "tree").drop("tree")
    w = Window.partitionBy(*keys, *PATH).orderBy(
        F.col("listed_at").asc_nulls_first(), "ref_type", "object_id", "metadata_id", *bounds.BOUNDS
    )
    return r.withColumn("_later", F.lead(F.lit(True)).over(w)).filter("_later is null").select(*keys, *COLUMNS[1:])


def ls_tree(nodes: DataFrame, path: str = "", strategy: str = "CHILDREN", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The rows below ``path`` by one of :data:`STRATEGIES`, with their full path; ``box`` keeps features that meet it."""
    deep, kind = STRATEGIES[strategy]
    parent = F.col("parent_path") if path else F.coalesce("parent_path", F.lit(""))
    on: Column = (parent == path) | paths.is_below(parent, path) if deep and path else F.lit(True) if deep else parent == path
    if kind:
        on = on & (F.col("ref_type") == kind)
    if box:
        on = on & ((F.col("ref_type") == "TREE") | bounds.intersects(box))
    return nodes.filter(on).withColumn("path", paths.full_path("parent_path", "ref_name"))


def find_child(nodes: DataFrame, path: str) -> DataFrame:
    """The row at a path: a lookup by both key columns."""
    parent, _, name = path.rpartition("/")
    at = F.col("parent_path") if parent else F.coalesce("parent_path", F.lit(""))
    return nodes.filter((at == parent) & (F.col("ref_name") == name))


def feature_type_trees(nodes: DataFrame) -> DataFrame:
    """Trees that have a feature type of their own."""
    return nodes.filter("ref_type = 'TREE' and metadata_id is not null")


def with_feature_type(nodes: DataFrame, feature_types: DataFrame, keys: list[str]) -> DataFrame:
    """Features with the name and fields of their type: their own metadata id, else that of their tree.

    ``keys`` identify the snapshot. ``feature_types`` is a fixed small table.
    """
    trees = feature_type_trees(nodes).select(*keys, paths.full_path("parent_path", "ref_name").alias("parent_path"), F.col("metadata_id").alias("_default"))
    types = feature_types.select(norm_id("metadata_id").alias("type_id"), "type_name", "field_list").dropDuplicates(["type_id"])
    features = nodes.filter("ref_type = 'FEATURE'")
    on = [features[k].eqNullSafe(trees[k]) for k in [*keys, "parent_path"]]
    joined = features.join(trees, on, "left").select(*[features[c] for c in features.columns], F.coalesce(features["metadata_id"], trees["_default"]).alias("type_id"))
    return joined.join(types, "type_id", "left")


def describe_types(feature_types: DataFrame) -> DataFrame:
    """``metadata_id type_name pos field field_type`` of every type, in order."""
    fields = F.posexplode(F.split("field_list", ","))
    return feature_types.select(norm_id("metadata_id").alias("metadata_id"), "type_name", fields.alias("pos", "f")).select(
        "metadata_id", "type_name", "pos", F.substring_index("f", ":", 1).alias("field"), F.substring_index("f", ":", -1).alias("field_type")
    )


def subtree_stats(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Features, bounds and a digest for each snapshot and parent path: what equal-subtree pruning and counts read.

    The digest is an order-free sum of 64-bit hashes of name and object id, so it is built by partial
    aggregation; two subtrees with other digests differ, and equal ones are taken to be equal.
    """
    h = F.xxhash64("ref_name", "ref_type", F.coalesce("object_id", F.lit("")))
    return nodes.groupBy(*keys, "parent_path").agg(
        F.count(F.when(F.col("ref_type") == "FEATURE", 1)).alias("n_features"),
        F.count("*").alias("n_rows"),
        F.sum(h.cast("decimal(20,0)")).alias("digest"),
        *bounds.envelope(),
    )
