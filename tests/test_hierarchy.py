import random

from conftest import rows

from chronofold.operators import hierarchy as h

NODES, EDGES = "id string, added_at timestamp, depth int", "src string, dst string, ord int, added_at timestamp, id string"


def brute(nodes, parent):
    out = {}
    for v in nodes:
        path, at = [v], v
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at in parent:
            out[v] = (min(path[path.index(parent[at]):]), -1)
        else:
            out[v] = (at, len(path) - 1)
    return out


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n, None, 1) for n in nodes], NODES), spark.createDataFrame([(a, b, o, None, "z") for a, b, o in edges], EDGES)


def test_against_brute_force(spark):
    for seed, base in ((1, 8), (2, 60), (3, h.BASE_ROWS)):
        rnd = random.Random(seed)
        names = [f"{i:03d}" for i in range(120)]
        rnd.shuffle(names)
        parent = {names[i]: names[i - 1] if rnd.random() < 0.7 else names[rnd.randrange(i)] for i in range(1, 90) if rnd.random() < 0.95}
        parent |= {names[i]: names[91 + (i - 90) % 5] for i in range(91, 96)} | {names[100]: names[100], names[101]: names[92], names[102]: names[101]}
        n, e = tables(spark, names, [(a, b, 0) for a, b in parent.items()] + [(names[5], names[7], 1), (names[3], "absent", 0)])
        got = h.hierarchy(n, e, base)
        want = brute(names, {k: v for k, v in parent.items()})
        assert {r["id"]: (r["root_id"], r["node_depth"]) for r in got.collect()} == want
    below = {v: sum(1 for w in names if w != v and want[w][1] > 0 and v in chain(w, parent)) for v in names if want[v][1] >= 0}
    assert {r["id"]: r["n_descendants"] for r in got.filter("node_depth >= 0").collect()} == below
    for block in (3, 4096):
        paths = {r["id"]: r["path"] for r in h.node_paths(got.filter("node_depth >= 0"), block).collect()}
        assert paths == {v: "/".join(reversed([v, *chain(v, parent)])) for v in below}
    some = spark.createDataFrame([(names[0],), (names[10],)], "id string")
    for block in (3, 4096):
        assert rows(h.descendants(got.filter("node_depth >= 0"), some, block)) == sorted((a, w) for a in (names[0], names[10]) for w in below if a in chain(w, parent))
        assert rows(h.descendants(got.filter("node_depth >= 0"), block=block)) == sorted((a, w) for w in below for a in chain(w, parent))


def chain(v, parent):
    out = []
    while v in parent and parent[v] not in out and parent[v] != v:
        v = parent[v]
        out.append(v)
    return out


def test_dirty_and_empty(spark):
    a, b = "a" * 40, "b" * 40
    n, e = tables(spark, [a.upper(), a + " ", b, None, "0" * 40], [(b, " " + a, 0), (b.upper(), a, 0), (None, a, 0), (a, None, 0)])
    assert rows(h.hierarchy(n, e).select("id", "root_id", "node_depth")) == [(a, a, 0), (b, a, 1)]
    n, e = tables(spark, [], [])
    assert rows(h.hierarchy(n, e)) == []
    n, e = tables(spark, [a], [])
    assert rows(h.hierarchy(n, e).select("id", "root_id", "node_depth", "n_descendants")) == [(a, a, 0, 0)]


def test_long_lists(spark):
    m = 3000
    rows_ = [(i, (i + 1 if i % 1000 != 999 else None), 1, 2, (i if i % 1000 == 999 else None)) for i in range(m)]
    lists = spark.createDataFrame(rows_, "e long, to long, cnt long, wt long, end long")
    got = {r["e"]: (r["end"], r["cnt"], r["wt"]) for r in h.rank_lists(lists, base_rows=50).collect()}
    assert got == {i: (i // 1000 * 1000 + 999, 1000 - i % 1000, 2 * (1000 - i % 1000)) for i in range(m)}


def test_loops_larger_than_a_task(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)] + [(20 + i, 20 + (i + 1) % 3) for i in range(3)] + [(30, 2)], "v long, p long")
    got = {r["v"]: r["loop"] for r in h.loops(ring, base_rows=2).collect()}
    assert got == {**{i: 0 for i in range(20)}, **{20 + i: 20 for i in range(3)}}


def test_every_node_has_path_and_interval(spark, tmp_path):
    from chronofold.plans import problems

    n, e = tables(spark, "abcxyr", [("a", "b", 0), ("b", "a", 0), ("x", "a", 0), ("y", "x", 0), ("c", "r", 0)])
    n.write.parquet(str(tmp_path / "nodes.parquet"))
    e.write.parquet(str(tmp_path / "edges.parquet"))
    got = {r["id"]: r for r in problems.p2_nodes(spark, str(tmp_path)).collect()}
    assert {k: (r["path"], r["looped"], r["n_descendants"]) for k, r in got.items()} == {
        "a": ("a", True, 2), "b": ("b", True, 0), "x": ("a/x", True, 1), "y": ("a/x/y", True, 0), "r": ("r", False, 1), "c": ("r/c", False, 0)
    }
    below = {(p, q) for p, a in got.items() for q, b in got.items() if a["tour_root"] == b["tour_root"] and b["entry"] < a["entry"] and b["exit"] > a["exit"]}
    assert below == {(p, q) for p, a in got.items() for q, b in got.items() if a["pos"] < b["pos"] <= a["pos"] + a["n_descendants"]}
    assert below == {("a", "x"), ("a", "y"), ("x", "y"), ("r", "c")}
