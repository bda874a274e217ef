import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronofold.functions import bounds, cql, geometry, natural, paths, revisions, tags, times, values, wkt


def test_paths(spark):
    d = spark.createDataFrame([("",), ("a",), ("a/b",), ("ab/c",), (None,)], "p string")
    got = {r[0]: tuple(r)[1:] for r in d.select("p", paths.parent_of("p"), paths.name_of("p"), paths.depth_of("p"), paths.is_below("p", "a"), paths.is_direct_child("p", "a")).collect()}
    assert got[""] == (None, "", 0, False, None) or got[""][:4] == (None, "", 0, False)
    assert got["a/b"] == ("a", "b", 2, True, True) and got["ab/c"] == ("ab", "c", 2, False, False) and got["a"][:3] == ("", "a", 1)
    assert d.filter("p = 'a/b'").select(paths.ancestor_paths("p")).first()[0] == ["a", "a/b"]


def test_bounds(spark):
    d = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0), (2.0, 3.0, 0.0, 1.0), (None, None, None, None)], "minx double, maxx double, miny double, maxy double")
    assert d.filter(bounds.intersects((1, 1, 2, 2))).count() == 3
    assert tuple(d.agg(*bounds.envelope()).first()) == (0, 3, 0, 1)
    m = d.limit(1).select(*bounds.to_mercator()).select(*bounds.to_degrees()).first()
    assert [round(x, 9) for x in m] == [0, 1, 0, 1]


def test_values_and_geometry(spark):
    text = "FEATURE\nSTRING\ta\tb\nNULL\tnull\nno tab\nPOINT\tPOINT (1 -2.5)"
    d = spark.createDataFrame([(text,), (None,), ("FEATURE",), ("COMMIT\nSTRING\tx",), ("",)], "t string")
    got = [r[0] for r in d.select(values.attributes("t")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, "STRING", "a\tb"), (1, "NULL", None), (2, "POINT", "POINT (1 -2.5)")]
    assert got[1] is None and got[2] == [] and got[3] == [] and got[4] == []
    p = d.limit(1).select(wkt.coordinates("t").alias("p")).first()[0]
    assert [tuple(x) for x in p] == [(1.0, -2.5)]
    ring = spark.createDataFrame([("LINESTRING (0 0, 1 0, 1 1)",)], "w string").select(wkt.close_ring(wkt.coordinates("w")).alias("r")).select(wkt.text(F.col("r"), "POLYGON")).first()[0]
    assert ring == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"
    assert geometry.edits("LINESTRING (1 1, 2 2)", "LINESTRING (1 1, 2 3, 4 4)") == (0, 1, 1)
    assert geometry.edits(None, "POINT (1 1)") == (0, 1, 0)
    assert geometry.merge_edits("LINESTRING (1 1, 2 2, 3 3)", "LINESTRING (1 2, 2 2, 3 3)", "LINESTRING (1 1, 2 2, 3 4)") == "LINESTRING (1 2, 2 2, 3 4)"
    assert geometry.merge_edits("LINESTRING (1 1, 2 2)", "LINESTRING (1 5, 2 2)", "LINESTRING (1 6, 2 2)") is None


def test_tags(spark):
    d = spark.createDataFrame([("a:b:c|x|k:1|k:2",), (None,), ("",)], "t string")
    got = [r[0] for r in d.select(tags.decode("t")).collect()]
    assert got == [{"a:b": "c", "k": "2"}, {}, {}]
    assert d.select(tags.encode(tags.decode("t"))).first()[0] == "a:b:c|k:2"


def test_natural_order(spark):
    assert natural.fnv64(["a", ""])[1] == natural.OFFSET
    h = natural.OFFSET
    for b in "Ab".encode("utf-16-be"):
        h = ((h ^ b) * natural.PRIME) % 2**64
    assert natural.fnv64(["Ab"])[0] == h
    d = spark.createDataFrame([("Ab",), (None,)], "n string").withColumn("k", natural.natural_key("n"))
    got = d.select("k", natural.bucket(F.col("k"), 0)).collect()
    assert got[0][0] == f"{h:016x}" and got[0][1] == (h >> 56) * 32 // 256 and got[1][0] is None


def test_times():
    now = dt.datetime(2020, 5, 5, 10, tzinfo=dt.timezone.utc)
    day = 86_400_000
    base = int(now.timestamp() * 1000)
    assert times.parse_time("5", now) == 5 and times.parse_time("yesterday", now) == base - 10 * 3_600_000 - day
    assert times.parse_time("2.weeks.ago", now) == base - 14 * day and times.parse_time("1.year.1.hour.ago", now) == base - 365 * day - 3_600_000
    assert times.parse_time("1970-01-01T00:00:01Z") == 1000
    for bad in ("soon", "2.moons.ago", "ago"):
        with pytest.raises(ValueError):
            times.parse_time(bad, now)


def test_revisions():
    r = revisions.parse("master~3^2^{commit}:a/b")
    assert (r.start, r.steps, r.path) == ("master", [("first", 3), ("parent", 2), ("type", "commit")], "a/b")
    assert revisions.parse("^").steps == [("parent", 1)] and revisions.parse(":x").path == "x"
    with pytest.raises(ValueError):
        revisions.parse("a^{x")


def test_cql(spark):
    d = spark.createDataFrame([("a'b", 1, 0.0, 1.0, 0.0, 1.0), ("c", 5, None, None, None, None)], "n string, v int, minx double, maxx double, miny double, maxy double")
    for text, want in {"n = 'a''b'": 1, "v BETWEEN 2 AND 9 OR n LIKE 'a%'": 2, "NOT (v IN (1, 2))": 1, "minx IS NULL": 1, "BBOX(g, 1, 1, 2, 2)": 1, "EXCLUDE": 0, "v <> 1 AND v != 7": 1}.items():
        assert d.filter(cql.to_sql(text)).count() == want, text
    for bad in ("v =", "v ~ 1", "(v = 1", "v = 1 v"):
        with pytest.raises(ValueError):
            cql.to_sql(bad)
    assert cql.path_filters("[default]\ntype=CQL\nfilter=INCLUDE\n[Points]\nfilter=v > 3")["Points"] == "(`v` > 3)"
    assert rows(d.select("v").filter(cql.to_sql("v >= -1.5e0"))) == [(1,), (5,)]
