"""Well-known text of geometries, by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def coordinates(wkt: str) -> Column:
    """``array<struct<x:double, y:double>>`` of the text in column ``wkt``, rings and parts in one list; null for null."""
    pairs = F.expr(f"regexp_extract_all({wkt}, '({_NUMBER})[ ]+({_NUMBER})', 0)")
    point = lambda s: F.struct(
        F.substring_index(s, " ", 1).cast("double").alias("x"), F.substring_index(s, " ", -1).cast("double").alias("y")
    )
    return F.transform(pairs, point)


def kind(wkt: Column | str) -> Column:
    """Geometry type in upper case."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    return F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))


def box(points: Column) -> list[Column]:
    """Bounds of a coordinate list."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return [F.array_min(x).alias("minx"), F.array_max(x).alias("maxx"), F.array_min(y).alias("miny"), F.array_max(y).alias("maxy")]


def is_closed(points: Column) -> Column:
    """First and last coordinate are the same and there are at least three."""
    return (F.size(points) >= 3) & (F.element_at(points, 1) == F.element_at(points, -1))


def close_ring(points: Column) -> Column:
    """Append the first coordinate unless the ring is closed; null if fewer than four coordinates result."""
    ring = F.when(is_closed(points), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.when(F.size(ring) >= 4, ring)


def text(points: Column, geometry: str) -> Column:
    """Well-known text of a POINT, LINESTRING or POLYGON of one ring."""
    inner = F.concat_ws(", ", F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))))
    a, b = ("((", "))") if geometry == "POLYGON" else ("(", ")")
    return F.when(F.size(points) > 0, F.concat(F.lit(f"{geometry} {a}"), inner, F.lit(b)))
