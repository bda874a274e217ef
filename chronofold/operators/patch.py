"""Patches: changes to be applied elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import apply_changes, reversed_changes
from .snapshots import PATH


def verify_patch(nodes: DataFrame, patch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The patch with ``verdict`` and ``applicable``: every row is judged against the listing.

    ADDED applies if the path is absent, REMOVED and MODIFIED if the path is there with the old object. The
    verdict is ``ok``, ``present`` (also when it already has the new object), ``absent`` or ``changed``.
    """
    at = [*(keys or []), *PATH]
    here = nodes.filter("ref_type = 'FEATURE'").select(*[F.col(c).alias("_" + c) for c in at], F.col("object_id").alias("_object"), F.lit(True).alias("_there"))
    j = patch.join(here, [patch[c].eqNullSafe(here["_" + c]) for c in at], "left")
    there = F.coalesce("_there", F.lit(False))
    verdict = (
        F.when(F.col("change_kind") == "ADDED", F.when(there, "present").otherwise("ok"))
        .when(~there, "absent")
        .when(F.col("_object").eqNullSafe(F.col("old_object_id")), "ok")
        .otherwise("changed")
    )
    return j.select(*[patch[c] for c in patch.columns], verdict.alias("verdict")).withColumn("applicable", F.col("verdict") == "ok")


def apply_patch(nodes: DataFrame, patch: DataFrame, keys: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """The listing after the applicable part of a patch; reversed patches undo it."""
    patch = reversed_changes(patch) if reverse else patch
    good = verify_patch(nodes, patch, keys).filter("applicable").drop("verdict", "applicable")
    return apply_changes(nodes, good, keys)


def patch_lines(patch: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Text blocks of a patch, one a row: kind, path and ids separated by tabs, then the new text if there is one."""
    from ..functions.ids import NULL_ID
    from ..functions.paths import full_path

    head = F.concat_ws(
        "\t", F.substring("change_kind", 1, 1), full_path("parent_path", "ref_name"),
        F.coalesce("old_object_id", F.lit(NULL_ID)), F.coalesce("new_object_id", F.lit(NULL_ID)),
    )
    if texts is None:
        return patch.select(head.alias("block"))
    t = texts.select(F.col("object_id").alias("new_object_id"), "object_text")
    return patch.join(t, "new_object_id", "left").select(F.concat_ws("\n", head, "object_text").alias("block"))


def read_patch_lines(blocks: DataFrame) -> DataFrame:
    """The changes of :func:`patch_lines`: ``parent_path ref_name change_kind old_object_id new_object_id new_text``."""
    from ..functions.ids import norm_id
    from ..functions.paths import name_of, parent_of

    head = F.split(F.substring_index("block", "\n", 1), "\t")
    kind = F.create_map(*[F.lit(x) for k in ("ADDED", "REMOVED", "MODIFIED") for x in (k[0], k)])
    text = F.when(F.contains("block", F.lit("\n")), F.regexp_replace("block", r"^[^\n]*\n", ""))
    return blocks.select(
        parent_of(head[1]).alias("parent_path"), name_of(head[1]).alias("ref_name"), kind[head[0]].alias("change_kind"),
        norm_id(head[2]).alias("old_object_id"), norm_id(head[3]).alias("new_object_id"), text.alias("new_text"),
    )
