from conftest import rows

from chronofold.operators import diff

LISTING = "line string, parent_path string, ref_name string, ref_type string, object_id string, metadata_id string, minx double, maxx double, miny double, maxy double"


def listing(spark, paths):
    return spark.createDataFrame([("l", "a", n, "FEATURE", o, None, None, None, None, None) for n, o in paths], LISTING)


def test_objects_at_several_paths_move(spark):
    old = listing(spark, [("1", "x"), ("2", "x"), ("3", "y"), ("4", "z"), ("5", "gone"), ("6", None), ("7", "w")])
    new = listing(spark, [("3", "y"), ("11", "x"), ("12", "z"), ("13", "z"), ("14", "z"), ("15", "new"), ("16", None), ("17", "w")])
    want = [("x", "old", "1"), ("x", "old", "2"), ("x", "new", "11"), ("z", "old", "4"), ("z", "new", "12"), ("z", "new", "13"), ("z", "new", "14"), ("w", "old", "7"), ("w", "new", "17")]
    assert rows(diff.moves(old, new, ["line"])) == sorted(("l", o, s, "a/" + n) for o, s, n in want)
    assert rows(diff.renames(old, new, ["line"])) == [("l", "w", "a/7", "a/17")]
