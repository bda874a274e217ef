"""Feature queries: filter, bounds, order, page, thin, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bounds
from ..functions.cql import to_sql
from .snapshots import PATH


def query(
    features: DataFrame, cql: str | None = None, box: tuple[float, float, float, float] | None = None, names: list[str] | None = None,
    columns: list[str] | None = None, order: list | None = None, skip: int = 0, limit: int | None = None,
) -> DataFrame:
    """Features by attribute filter, box and names; an order is completed by the path, so pages are stable.

    All filters are conjuncts over plain columns, so they and the selected columns reach the Parquet scan.
    """
    out = features
    if cql:
        out = out.filter(F.expr(to_sql(cql)))
    if box:
        out = out.filter(bounds.intersects(box))
    if names is not None:
        out = out.filter(F.col("ref_name").isin(names))
    if order or skip or limit is not None:
        out = out.orderBy(*(order or []), *[c for c in PATH if c in out.columns]).offset(skip)
        if limit is not None:
            out = out.limit(limit)
    return out.select(columns) if columns else out


def filter_by_path(features: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Filters (SQL) by parent path, with ``default`` for the others; paths without any filter are kept."""
    rest = filters.get("default", "true")
    listed = [p for p in filters if p != "default"]
    cond = F.expr(rest) if rest else F.lit(True)
    for p in listed:
        cond = F.when(F.col("parent_path") == p, F.expr(filters[p])).otherwise(cond)
    return features.filter(F.coalesce(cond, F.lit(False)))


def extent(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count and bounds (for each key)."""
    return features.groupBy(*(keys or [])).agg(F.count("*").alias("n_features"), *bounds.envelope())


def thin(features: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """One feature for each grid cell of ``size``: the first by path; features without bounds are left out.

    Built by an aggregate, so a crowded cell is reduced in the map tasks.
    """
    cells = features.filter("minx is not null and maxx is not null and miny is not null and maxy is not null").select("*", *bounds.cell(size))
    rest = [c for c in features.columns if c not in (keys or [])]
    lead = [c for c in PATH if c in rest] + [c for c in rest if c not in PATH]
    first = cells.groupBy(*(keys or []), "cell_x", "cell_y").agg(F.min(F.struct(*lead)).alias("x"), F.count("*").alias("n_in_cell"))
    return first.select(*(keys or []), "cell_x", "cell_y", *[f"x.{c}" for c in lead], "n_in_cell")


#: A box goes to cells of the smallest level in which it covers at most so many in each direction.
SPAN = 2


def box_join(a: DataFrame, b: DataFrame, size: float, keys: list[str] | None = None, levels: int = 24) -> DataFrame:
    """Pairs of features (with equal ``keys``) whose bounds meet, ``a_*`` and ``b_*``: an equi-join on grid cells with an exact residual.

    Grids double in size from level to level, the first with cells of ``size``. A box belongs to the first level in which
    it covers at most ``SPAN`` cells in each direction, or the last, so a large box has as few rows as a small one; it also
    visits the cells of the coarser levels that hold it, and the other side those that boxes of theirs belong to: of any
    two boxes, one meets the other at the coarser one's level. A pair is reported in the cell of the lower-left corner of its
    intersection only, so it comes once.
    """
    keys = list(keys or [])
    used = sorted(r["l"] for r in _levels(a, size, levels).select("l").union(_levels(b, size, levels).select("l")).distinct().collect())

    def gridded(d: DataFrame, p: str) -> DataFrame:
        own = _levels(d, size, levels).select(*[F.col(n).alias(p + n) for n in d.columns], F.col("l").alias(p + "l"))
        at = F.explode(F.filter(F.array(*[F.lit(u) for u in used] or [F.lit(0)]), lambda u: u >= F.col(p + "l"))).alias("l")
        cell = lambda n: F.floor(F.col(p + n) / (F.lit(size) * F.pow(F.lit(2.0), F.col("l"))))
        rows = own.select("*", at).select("*", F.explode(F.sequence(cell("minx"), cell("maxx"))).alias("gx"))
        return rows.select("*", F.explode(F.sequence(cell("miny"), cell("maxy"))).alias("gy"))

    x = gridded(a, "a_").withColumns({"_" + k: F.col("a_" + k) for k in keys})
    y = gridded(b, "b_").withColumns({"_" + k: F.col("b_" + k) for k in keys})
    j = x.join(y, ["l", "gx", "gy", *["_" + k for k in keys]]).filter(F.col("l") == F.greatest("a_l", "b_l"))
    meet = (F.col("a_minx") <= F.col("b_maxx")) & (F.col("a_maxx") >= F.col("b_minx")) & (F.col("a_miny") <= F.col("b_maxy")) & (F.col("a_maxy") >= F.col("b_miny"))
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("l"))
    corner = (F.floor(F.greatest("a_minx", "b_minx") / width) == F.col("gx")) & (F.floor(F.greatest("a_miny", "b_miny") / width) == F.col("gy"))
    return j.filter(meet & corner).drop("l", "gx", "gy", "a_l", "b_l", *["_" + k for k in keys])


def _levels(d: DataFrame, size: float, levels: int) -> DataFrame:
    """``d``'s rows with bounds and ``l``, the grid level of each."""
    whole = d.filter("minx is not null and maxx is not null and miny is not null and maxy is not null")
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.ceil(F.log2(F.greatest(side / F.lit(size * (SPAN - 1)), F.lit(1.0)))).cast("int")
    return whole.withColumn("l", F.least(level, F.lit(levels - 1)))
