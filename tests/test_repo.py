import pytest
from conftest import rows

from chronofold.repo import ConflictError, Repo
from chronofold.sources import geojson, tables

KINDS = {"sp": "STRING", "ip": "INTEGER", "pp": "POINT"}
POINTS = [("Points.1", "StringProp1_1", 1000, "POINT (1 1)"), ("Points.2", "StringProp1_2", 2000, "POINT (2 2)"), ("Points.3", "StringProp1_3", 3000, "POINT (3 3)")]


def put(repo, features, path="Points"):
    repo.insert(path, repo.spark.createDataFrame(features, "fid string, sp string, ip int, pp string"), "fid", KINDS, "pp")


@pytest.fixture
def repo(spark, tmp_path):
    r = Repo.init(spark, str(tmp_path / "r"), {"user.name": "A"})
    put(r, POINTS[:2])
    r.commit("first", when=1, all=True)
    return r


def names(repo, spec="HEAD"):
    return [x[0] for x in rows(repo.nodes(spec).filter("ref_type = 'FEATURE'").select("ref_name"))]


def test_commit_status_log(repo):
    with pytest.raises(ValueError):
        repo.commit("nothing")
    put(repo, POINTS[2:])
    assert repo.status() == {"staged": 0, "unstaged": 1, "conflicts": 0}
    repo.add("Points")
    assert repo.status()["staged"] == 1
    c2 = repo.commit("second", when=2)
    assert [c["message"] for c in repo.log()] == ["second", "first"] and repo.resolve("HEAD~1") == repo.commits()[c2]["parents"][0]
    assert names(repo) == ["Points.1", "Points.2", "Points.3"] and names(repo, "HEAD^") == ["Points.1", "Points.2"]
    assert rows(repo.diff("HEAD~1", "HEAD").select("ref_name", "change_kind")) == [("Points.3", "ADDED")]
    assert repo.diff("HEAD", "HEAD").count() == 0
    got = repo.features("Points").filter("ref_name = 'Points.2'").first()
    assert [a["value"] for a in got["attributes"]] == ["StringProp1_2", "2000", "POINT (2 2)"] and got["minx"] == 2.0
    repo.tag("v1")
    assert repo.tree_of("v1") == repo.tree_of("HEAD")
    repo.delete("Points", repo.spark.createDataFrame([("Points.1",)], "ref_name string"))
    repo.checkout_paths("Points")
    assert repo.status()["unstaged"] == 0
    repo.reset("HEAD~1", "HARD")
    assert names(repo) == ["Points.1", "Points.2"]


def test_merge_pick_revert_rebase(repo):
    repo.branch_create("b", checkout=True)
    put(repo, [("Points.1", "theirs", 1000, "POINT (1 1)")])
    theirs = repo.commit("theirs", when=2, all=True)
    repo.checkout("master")
    put(repo, [("Points.1", "StringProp1_1", 1001, "POINT (1 1)"), POINTS[2]])
    repo.commit("ours", when=3, all=True)
    repo.merge("b")
    got = repo.features("Points").filter("ref_name = 'Points.1'").first()["attributes"]
    assert [a["value"] for a in got] == ["theirs", "1001", "POINT (1 1)"]
    assert len(repo.commits()[repo.head]["parents"]) == 2
    repo.reset("HEAD^1", "HARD")
    repo.cherry_pick(theirs)
    assert [a["value"] for a in repo.features("Points").filter("ref_name = 'Points.1'").first()["attributes"]][:2] == ["theirs", "1001"]
    repo.revert("HEAD")
    assert repo.features("Points").filter("ref_name = 'Points.1'").first()["attributes"][0]["value"] == "StringProp1_1"
    repo.reset("HEAD~2", "HARD")
    repo.rebase("b")
    assert [c["message"] for c in repo.log(first_parent=True)][:2] == ["ours", "theirs"] or repo.commits()[repo.head]["message"] == "ours"
    repo.squash("b~1", "one")
    assert [c["message"] for c in repo.log()] == ["one", "first"]


def test_conflict(repo):
    repo.branch_create("b", checkout=True)
    put(repo, [("Points.1", "theirs", 1, "POINT (1 1)")])
    repo.commit("theirs", when=2, all=True)
    repo.checkout("master")
    put(repo, [("Points.1", "ours", 2, "POINT (1 1)")])
    repo.commit("ours", when=3, all=True)
    with pytest.raises(ConflictError):
        repo.merge("b")
    c = repo.conflicts()
    assert [x["ref_name"] for x in c] == ["Points.1"]
    with pytest.raises(ConflictError):
        repo.commit("no")
    repo.resolve_conflict("Points", "Points.1", c[0]["theirs"])
    repo.commit("merged", when=4)
    assert repo.features("Points").filter("ref_name = 'Points.1'").first()["attributes"][0]["value"] == "theirs"


def test_patch_transaction_clone(repo, spark, tmp_path):
    put(repo, POINTS[2:])
    repo.commit("second", when=2, all=True)
    p = repo.create_patch("HEAD~1", "HEAD")
    assert repo.apply_patch(p, partial=True).count() == 1
    repo.apply_patch(p, reverse=True)
    assert names(repo, "WORK_HEAD") == ["Points.1", "Points.2"]
    repo.reset("HEAD", "HARD")
    with pytest.raises(RuntimeError), repo.transaction() as t:
        t.branch_create("gone")
        raise RuntimeError
    assert repo.branches() == ["master"]
    with repo.transaction() as t:
        put(t, [("Points.7", "t", 7, "POINT (7 7)")])
        t.commit("in transaction", when=5, all=True)
        assert "Points.7" not in names(repo) and "Points.7" in names(t)
    assert "Points.7" in names(repo) and "Points.7" in names(repo, "WORK_HEAD")
    other = Repo.clone(spark, repo.path, str(tmp_path / "c"))
    assert names(other) == names(repo) and other.head == repo.head
    put(other, [("Points.9", "n", 9, "POINT (9 9)")])
    other.commit("third", when=3, all=True)
    other.push()
    assert repo.head == other.head and "Points.9" in names(repo)
    seen = []
    repo.on("pre_commit", lambda r, message: seen.append(message))
    put(repo, [("Points.8", "n", 9, "POINT (9 9)")])
    repo.commit("fourth", when=4, all=True)
    assert seen == ["fourth"]
    other.pull()
    assert other.head == repo.head


def test_sources(repo, spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a\\"1", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4.5]]}, "properties": {"p": "q", "n": 1.5}},'
                 '{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[[1, 2]]]}, "properties": {"p": null}}]}')
    d = geojson.read_geojson(spark, str(f), "p string, n double")
    assert rows(d) == [("a\"1", "q", 1.5, "LINESTRING (1.0 2.0, 3.0 4.5)"), (None, None, None, None)]
    geojson.write_geojson(d, str(tmp_path / "out"))
    assert rows(geojson.read_lines(spark, str(tmp_path / "out"), "p string, n double")) == rows(d)
    t = tables.export_features(repo.features("Points"), [("sp", "STRING"), ("ip", "INTEGER")])
    assert rows(t) == [("Points.1", "StringProp1_1", 1000), ("Points.2", "StringProp1_2", 2000)]
    assert tables.describe(t)["ip"] == "int" and tables.adapt(t, "ip long, z string").first()["z"] is None
    assert tables.jdbc_options("postgis", "d", port=1)["url"] == "jdbc:postgresql://localhost:1/d"


def test_no_conflict_is_lost(repo, spark):
    n = 100_005
    side = lambda object_id: spark.range(n).selectExpr(
        "'Many' as parent_path", "cast(id as string) as ref_name", "'FEATURE' as ref_type", f"'{object_id}' as object_id", "cast(null as string) as metadata_id",
        *[f"cast(null as double) as {c}" for c in ("minx", "maxx", "miny", "maxy")],
    )
    _, left, open_ = repo._merge_trees(side("0").limit(0), side("1"), side("2"), None)
    repo._keep_conflicts(open_)
    assert left == n and repo.status()["conflicts"] == n
    repo.resolve_conflict("Many", "7", "2")
    assert repo.open_conflicts().count() == n - 1 and repo.open_conflicts().filter("ref_name = '7'").count() == 0
    with pytest.raises(ConflictError):
        repo.commit("no")


def test_values_of_several_lines_and_arrays(repo, spark):
    odd = "a\nb\tc\\n d\r\\"
    d = spark.createDataFrame([("x", odd, [1, 2, None], [])], "fid string, t string, a array<int>, e array<double>")
    repo.insert("Odd", d, "fid", {"t": "STRING", "a": "INTEGER_ARRAY", "e": "DOUBLE_ARRAY"})
    f = repo.features("Odd", "WORK_HEAD")
    assert f.first()["attributes"][0]["value"] == odd
    out = tables.export_features(f, [("t", "STRING"), ("a", "INTEGER_ARRAY"), ("e", "DOUBLE_ARRAY")]).first()
    assert (out["t"], out["a"], out["e"]) == (odd, [1, 2, None], [])


def test_merge_of_trees(repo):
    repo.branch_create("b", checkout=True)
    put(repo, [("Lines.1", "l", 1, "POINT (5 5)")], "Lines/deep")
    repo.commit("tree", when=2, all=True)
    repo.branch_create("c", "HEAD~1", checkout=True)
    put(repo, [("Other.1", "l", 1, "POINT (5 5)")], "Other")
    repo.commit("other", when=3, all=True)
    repo.checkout("master")
    put(repo, [POINTS[2]])
    before = repo.commit("third", when=4, all=True)
    assert not repo.check_merge("b", "c")
    repo.merge("b", "c")
    assert len(repo.commits()[repo.head]["parents"]) == 3
    assert {r[0] for r in rows(repo.nodes().filter("ref_type = 'TREE'").select("ref_name"))} == {"Points", "Lines", "deep", "Other"}
    # one side drops a tree, the other adds to it
    repo.reset(before, "HARD")
    repo.branch_create("d", checkout=True)
    repo.delete("Points")
    repo.commit("no points", when=5, all=True)
    repo.checkout("master")
    put(repo, [("Points.4", "new", 4, "POINT (4 4)")])
    repo.commit("more points", when=6, all=True)
    with pytest.raises(ConflictError):
        repo.merge("d", message="both")
    assert [(c["parent_path"], c["ref_name"]) for c in repo.conflicts()] == [("", "Points")] and repo.merge_message() == "both"
    repo.checkout_side("Points", "ours")
    at = repo.commit(when=7)
    assert repo.commits()[at]["message"] == "both"
    assert "Points.4" in names(repo)


def test_geometries_are_merged_by_coordinate(repo):
    put(repo, [("L", "x", 1, "LINESTRING (0 0, 1 1, 2 2, 3 3)")])
    repo.commit("line", when=2, all=True)
    repo.branch_create("b", checkout=True)
    put(repo, [("L", "x", 1, "LINESTRING (0 9, 1 1, 2 2, 3 3)")])
    repo.commit("start", when=3, all=True)
    repo.checkout("master")
    put(repo, [("L", "x", 1, "LINESTRING (0 0, 1 1, 2 2, 8 3)")])
    repo.commit("end", when=4, all=True)
    repo.merge("b")
    f = repo.features("Points").filter("ref_name = 'L'").first()
    assert f["attributes"][2]["value"] == "LINESTRING (0 9, 1 1, 2 2, 8 3)" and (f["maxx"], f["maxy"]) == (8.0, 9.0)


def test_continue_skip_abort(repo):
    repo.branch_create("b", checkout=True)
    put(repo, [("Points.1", "b", 1, "POINT (1 1)")])
    repo.commit("theirs", when=2, all=True)
    repo.checkout("master")
    put(repo, [("Points.1", "m", 2, "POINT (1 1)")])
    repo.commit("clash", when=3, all=True)
    put(repo, [POINTS[2]])
    orig = repo.commit("fine", when=4, all=True)
    for end in ("abort", "skip", "continue_"):
        with pytest.raises(ConflictError):
            repo.rebase("b")
        if end == "continue_":
            with pytest.raises(ConflictError):
                repo.continue_()
            repo.resolve_conflict("Points", "Points.1", repo.conflicts()[0]["theirs"])
        getattr(repo, end)()
        said = [c["message"] for c in repo.log(topological=True)]
        assert said == {"abort": ["fine", "clash", "first"], "skip": ["fine", "theirs", "first"], "continue_": ["fine", "clash", "theirs", "first"]}[end]
        if end != "continue_":
            repo.reset(orig, "HARD")
    assert not repo.open_conflicts().count()
    repo.squash("b", "two", "HEAD~1")
    assert [c["message"] for c in repo.log(topological=True)] == ["fine", "two", "theirs", "first"]
    assert [c["message"] for c in repo.log(paths=["Points/Points.3"])] == ["fine"] and len(repo.log(author="A", skip=1, limit=2)) == 2
    assert repo.ref_parse("b") == "refs/heads/b" and repo.resolve("HEAD^{tree}") == repo.tree_of("HEAD") and repo.resolve("HEAD:Points/Points.3") == repo.node("Points/Points.3")["object_id"]


def test_shallow_clone_and_specs(repo, spark, tmp_path):
    put(repo, POINTS[2:])
    repo.commit("second", when=2, all=True)
    other = Repo.clone(spark, repo.path, str(tmp_path / "s"), depth=1)
    assert other.is_shallow and len(other.log()) == 1 and names(other) == names(repo)
    assert other.ls_remote() == {"refs/heads/master": repo.head}
    other.push(spec="master:copy")
    assert repo.branches() == ["copy", "master"]
    other.push(spec=":copy")
    assert repo.branches() == ["master"] and other.fetch(specs=["refs/heads/*:refs/x/*"]) == {"refs/x/master": (None, repo.head)}
    repo.branch_create("alone", orphan=True)
    assert repo.head is None and repo.commit("root", when=9) and repo.commits()[repo.head]["parents"] == []
