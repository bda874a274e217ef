import pytest

from chronofold import cli

KINDS = "sp:STRING,ip:INTEGER,pp:POINT"


@pytest.fixture
def run(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setenv("CHRONOFOLD_CONFIG", str(tmp_path / "settings.json"))

    def go(*argv, code=0, repo="r"):
        capsys.readouterr()
        assert cli.main(["--repo", str(tmp_path / repo), *argv]) == code
        out = capsys.readouterr()
        return (out.err if code else out.out).strip().splitlines()

    return go


def test_commands(run, spark, tmp_path):
    r = str(tmp_path / "r")
    run("init", r)

    def put(*features, path="Points"):
        f = tmp_path / "in.csv"
        f.write_text("fid,sp,ip,pp\n" + "".join(f'{a},{b},{c},"{d}"\n' for a, b, c, d in features))
        run("insert", "-f", str(f), path, "--kinds", KINDS, "--geometry", "pp")

    put(("p1", "one", 1, "POINT (1 1)"), ("p2", "two", 2, "POINT (2 2)"))
    assert run("add", "-n")[-1] == "A  Points/p2"
    run("config", "--global", "user.name", "A")
    assert run("config", "user.name") == ["A"] and run("config", "-l", "--global") == ["user.name=A"]
    run("add")
    assert run("diff", "--cached", "--count") == ["Features changed: total: 2, added: 2, modified: 0, removed: 0"]
    assert run("commit", "-m", "first", "-t", "1")[0].endswith("first") and run("commit", "-m", "none", code=1) == ["error: nothing to commit"]
    put(("p1", "uno", 1, "POINT (1 9)"))
    assert [x for x in run("status") if x[0].isdigit()] == ["0 staged", "1 unstaged", "0 conflicts"]
    assert run("diff", "--nogeom")[1:] == ["Points/p1 0: one -> uno"] and run("diff", "--bounds")[2] == "both: 1.0,1.0,1.0,9.0"
    run("commit", "-m", "second", "-t", "2", "--all")
    assert run("log", "--oneline")[0].endswith("second") and run("log", "HEAD~1..HEAD", "--csv")[1].startswith("MODIFIED,Points/p1,")
    blamed = [x.split() for x in run("blame", "Points/p1")]
    second, first = run("rev-parse", "HEAD", "HEAD~1")
    assert [b[1] for b in blamed] == [second[:8], first[:8], second[:8]]
    assert run("ls", "Points") == ["Points/p1", "Points/p2"] and run("ls-tree", "-r", "HEAD") == ["Points", "Points/p1", "Points/p2"]
    assert run("cat", "HEAD:Points/p1")[1] == "STRING\tuno" and run("cat", "HEAD")[0] == "COMMIT" and run("show", "HEAD:Points/p1")[1] == "0 (STRING): uno"
    assert run("show-ref") == [f"{second} refs/heads/master"] and run("merge-base", "HEAD", "HEAD~1") == [first]
    assert run("rebuild-graph") == ["1 links"] and len(run("rev-list")) == 11 and len(run("walk-graph")) == 8
    run("tag", "v1", "-m", "x")
    assert run("tag") == ["v1"]
    patch = str(tmp_path / "p")
    run("format-patch", "HEAD~1", "HEAD", "-f", patch)
    assert run("verify-patch", patch) == ["MODIFIED Points/p1: changed"] and run("apply", patch, "--reverse") == ["0 rejected"]
    assert run("diff-tree", "HEAD") != [] and run("checkout", "-p", "Points") == []
    run("branch", "-c", "b", "HEAD~1")
    put(("p1", "clash", 1, "POINT (1 1)"))
    run("commit", "-m", "theirs", "-t", "3", "--all")
    assert run("branch") == ["* b", "  master"]
    assert run("merge", "master", code=1) == ["error: 1 conflicts"]
    assert run("conflicts", "--ids-only") == ["Points/p1"] and run("merge", "--abort") == []
    assert run("rebase", "master", code=1) and run("rebase", "--skip") == [second]
    run("rm", "Points/p2")
    assert run("rm", "Points", code=1) and run("reset", "--hard") == []
    assert run("revert", "HEAD") and run("cat", "HEAD:Points/p1")[1] == "STRING\tone"
    other = str(tmp_path / "o")
    run("clone", r, other, "-b", "master")
    assert run("remote", "list", repo="o") == ["origin"] and run("log", "--oneline", repo="o")[0].endswith("second")
    assert run("fetch", repo="o") == [] and run("push", "origin", "master:copy", repo="o") == [second] and "  copy" in run("branch")
    assert run("version") and "log" in run("help") and run("clean") == []
    out = str(tmp_path / "out")
    run("geojson", "export", "Points", out, "--kinds", "sp:STRING,ip:INTEGER,geom:POINT")
    from chronofold.sources import geojson

    assert geojson.read_lines(spark, out, "sp string, ip int").count() == 2
