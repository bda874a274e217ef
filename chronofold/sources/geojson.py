"""GeoJSON feature collections as tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: GeoJSON geometry types and how deeply their coordinates are nested. Fixed values.
NESTING = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _wkt(text: str | None) -> str | None:
    import json

    if text is None:
        return None
    try:
        g = json.loads(text)
        depth = NESTING[g["type"]]

        def part(c, d: int) -> str:
            if d == 0:
                return " ".join(str(float(x)) for x in c[:2])
            return "(" + ", ".join(part(x, d - 1) for x in c) + ")"

        body = part(g["coordinates"], depth)
        return f"{g['type'].upper()} {body if depth else '(' + body + ')'}"
    except (KeyError, TypeError, ValueError, IndexError):
        return None


def read_geojson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of a collection: ``fid``, the properties of ``schema``, and ``geom`` as well-known text.

    One document a file; files are read in parallel. A malformed geometry gives a null ``geom``. Without an id a
    feature's ``fid`` is null.
    """
    feature = f"array<struct<id:string,properties:struct<{schema}>,geometry:string>>"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"struct<features:{feature}>")["features"]).alias("f"))

    @F.pandas_udf("string")
    def wkt(s):
        return s.map(_wkt, na_action="ignore")

    return rows.select(F.col("f.id").alias("fid"), "f.properties.*", wkt("f.geometry").alias("geom"))


def write_geojson(features: DataFrame, path: str, fid: str = "fid", geom: str = "geom") -> None:
    """One feature a line (newline-delimited GeoJSON), written in parallel."""
    props = [c for c in features.columns if c not in (fid, geom)]
    kind = F.upper(F.regexp_extract(geom, r"^\s*([A-Za-z]+)", 1))
    names = F.create_map(*[F.lit(x) for k in NESTING for x in (k.upper(), k)])
    body = F.regexp_replace(F.regexp_replace(F.col(geom), r"^\s*[A-Za-z]+\s*", ""), r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)", "[$1, $2]")
    lists = F.translate(body, "()", "[]")
    coords = F.when(kind == "POINT", F.expr("substring(_l, 2, length(_l) - 2)")).otherwise(F.col("_l"))
    part = features.withColumn("_l", lists)
    geometry = F.when(F.col(geom).isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('{"type": "'), F.try_element_at(names, kind), F.lit('", "coordinates": '), coords, F.lit("}"))
    )
    properties = F.to_json(F.struct(*props)) if props else F.lit("{}")
    # a JSON string is what an array of one holds between its brackets
    quoted = F.expr(f"substring(to_json(array(cast(`{fid}` as string))), 2, length(to_json(array(cast(`{fid}` as string)))) - 2)")
    line = F.concat(
        F.lit('{"type": "Feature", "id": '), F.coalesce(quoted, F.lit("null")), F.lit(', "geometry": '), geometry, F.lit(', "properties": '), properties, F.lit("}")
    )
    part.select(line.alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_geojson` wrote; splits large files."""
    f = F.from_json("value", f"struct<id:string,properties:struct<{schema}>,geometry:string>")

    @F.pandas_udf("string")
    def wkt(s):
        return s.map(_wkt, na_action="ignore")

    return spark.read.text(path).select(f.alias("f")).select(F.col("f.id").alias("fid"), "f.properties.*", wkt("f.geometry").alias("geom"))
