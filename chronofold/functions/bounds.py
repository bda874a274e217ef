"""Bounds as four double columns ``minx maxx miny maxy``; a null means no bounds, which meet nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ["minx", "maxx", "miny", "maxy"]
#: Half the circumference of the sphere of spherical Mercator coordinates, in metres. Fixed value.
HALF_WORLD = 20037508.342789244


def intersects(box: tuple[float, float, float, float], prefix: str = "") -> Column:
    """Closed-interval intersection with ``(minx, miny, maxx, maxy)``; the four conjuncts reach the Parquet scan."""
    x0, y0, x1, y1 = map(float, box)
    c = lambda n: F.col(prefix + n)
    return F.coalesce((c("minx") <= x1) & (c("maxx") >= x0) & (c("miny") <= y1) & (c("maxy") >= y0), F.lit(False))


def envelope(prefix: str = "", out: str = "") -> list[Column]:
    """Aggregates that give the bounds of all rows; none if no row has bounds."""
    agg = {"minx": F.min, "maxx": F.max, "miny": F.min, "maxy": F.max}
    return [agg[n](prefix + n).alias(out + n) for n in BOUNDS]


def merged(a: str, b: str, out: str) -> list[Column]:
    """Union of two bounds; missing ones don't count."""
    agg = {"minx": F.least, "maxx": F.greatest, "miny": F.least, "maxy": F.greatest}
    return [agg[n](F.col(a + n), F.col(b + n)).alias(out + n) for n in BOUNDS]


def same(a: str, b: str) -> Column:
    out = F.lit(True)
    for n in BOUNDS:
        out = out & F.col(a + n).eqNullSafe(F.col(b + n))
    return out


def to_mercator(prefix: str = "") -> list[Column]:
    """Degrees to spherical Mercator metres; monotone, so the bounds of a box are the box of its bounds."""
    x = lambda c: c / 180 * HALF_WORLD
    y = lambda c: F.log(F.tan((90 + c) * 3.141592653589793 / 360)) / 3.141592653589793 * HALF_WORLD
    return [(x if n.endswith("x") else y)(F.col(prefix + n)).alias(prefix + n) for n in BOUNDS]


def to_degrees(prefix: str = "") -> list[Column]:
    x = lambda c: c / HALF_WORLD * 180
    y = lambda c: F.atan(F.exp(c / HALF_WORLD * 3.141592653589793)) * 360 / 3.141592653589793 - 90
    return [(x if n.endswith("x") else y)(F.col(prefix + n)).alias(prefix + n) for n in BOUNDS]


def cell(size: float, prefix: str = "") -> list[Column]:
    """Grid cell of a box's centre, for thinning a map to one feature a pixel."""
    mid = lambda a, b: F.floor((F.col(prefix + a) + F.col(prefix + b)) / 2 / size)
    return [mid("minx", "maxx").alias("cell_x"), mid("miny", "maxy").alias("cell_y")]
