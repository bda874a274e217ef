import random

import pytest

from conftest import rows

from chronofold.operators import graph


def reach(v, up):
    out, todo = set(), [v]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += up.get(x, [])
    return out


def test_against_brute_force(spark):
    rnd = random.Random(8)
    names = [f"{i:03d}" for i in range(40)]
    up, edges = {}, []
    for i in range(1, 40):
        ps = rnd.sample(names[max(0, i - 6):i], min(i, 1 + (rnd.random() < 0.3))) if rnd.random() < 0.95 else []
        up[names[i]] = ps
        edges += [(names[i], p, o) for o, p in enumerate(ps)]
    g = graph.Graph(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(edges, "src string, dst string, ord int"))
    assert rows(g.reach(spark.createDataFrame([(n, n) for n in names[-5:]], "start string, id string"))) == sorted((n, m) for n in names[-5:] for m in reach(n, up))
    low, high = {}, {}
    for n in names:
        low[n] = 1 + min(low[p] for p in up[n]) if up.get(n) else 0
        high[n] = 1 + max(high[p] for p in up[n]) if up.get(n) else 0
    assert dict(rows(g.depths())) == low and dict(rows(g.topological())) == high
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(8)]
    df = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "pair string, left_id string, right_id string").distinct()
    want = set()
    for a, b in pairs:
        both = reach(a, up) & reach(b, up)
        want |= {(f"{a}-{b}", c) for c in both if not any(c in up.get(x, []) for x in both)}
    assert set(rows(g.common_ancestors(df))) == want
    marked = spark.createDataFrame([(names[12],)], "id string")
    got = dict(rows(g.passes(df, marked)))
    assert got == {f"{a}-{b}": names[12] in reach(a, up) and b in reach(names[12], up) for a, b in pairs}
    assert dict(rows(g.children().select("id", "n_children"))) == {n: sum(n in ps for ps in up.values()) for n in names}


def test_loops_against_brute_force(spark):
    # a > b > c > a is a loop with x, y below; y merges into t > r; s > s hangs on itself; u only has a second parent
    links = [("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("x", "a", 0), ("y", "x", 0), ("y", "t", 1), ("t", "r", 0), ("z", "y", 0), ("w", "x", 0), ("w", "t", 1), ("s", "s", 0), ("q", "s", 0), ("u", "r", 1)]
    names = sorted({n for a, b, _ in links for n in (a, b)})
    up = {n: [b for a, b, _ in links if a == n] for n in names}
    g = graph.Graph(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(links, "src string, dst string, ord int"))
    assert rows(g.children()) == sorted((n, sum(n in p for p in up.values()), len(up[n])) for n in names)
    assert rows(g.reach(spark.createDataFrame([(n, n) for n in names], "start string, id string"))) == sorted((n, m) for n in names for m in reach(n, up))
    low = {n: None if up[n] else 0 for n in names}
    for _ in names:
        low = {n: min([1 + low[p] for p in up[n] if low[p] is not None], default=None) if up[n] else 0 for n in names}
    assert dict(rows(g.depths())) == low
    pairs = [("y", "w"), ("z", "c"), ("x", "w"), ("t", "u"), ("q", "s"), ("b", "c"), ("q", "r")]
    want = set()
    for a, b in pairs:
        both = reach(a, up) & reach(b, up)
        want |= {(f"{a}-{b}", c) for c in both if not any(c in reach(x, up) and x not in reach(c, up) for x in both)}
    df = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "pair string, left_id string, right_id string")
    assert set(rows(g.common_ancestors(df))) == want
    got = rows(g.first_parents(spark.createDataFrame([("z", "z"), ("b", "b"), ("q", "q")], "start string, id string")))
    assert got == sorted([("z", n, i) for i, n in enumerate("zyxabc")] + [("b", n, i) for i, n in enumerate("bca")] + [("q", "q", 0), ("q", "s", 1)])


def ladder(n):
    """A loop of ``n`` with tails, merges between the tails, a chain of merges and two lone nodes: links and parents."""
    links = [(f"o{i:03d}", f"o{(i + 1) % n:03d}", 0) for i in range(n)] + [("t0", "o000", 0), ("t1", "o003", 0), ("t1", "t0", 1), ("t2", "t0", 0), ("t2", "t1", 1), ("t3", "t2", 0), ("t3", "m03", 1), ("t4", "m05", 0), ("t4", "t1", 1)]
    links += [(f"m{i:02d}", f"m{i - 1:02d}", 0) for i in range(1, 30)] + [(f"m{i:02d}", f"m{i - 3:02d}", 1) for i in range(3, 30)] + [("t5", "t5", 0), ("t6", "t5", 0), ("t6", "m02", 1)]
    up = {}
    for a, b, _ in links:
        up.setdefault(a, []).append(b)
    return links, sorted({x for a, b, _ in links for x in (a, b)} | {"u1", "u2"}), up


SIZES = [{}, {"BITS": 2}, {"BLOCK_LINKS": 8, "SLICE": 100}, {"BLOCK_LINKS": 8, "WHOLE_LINKS": 50}]


@pytest.mark.parametrize("sizes", SIZES)
def test_common_ancestors_of_blocks(spark, monkeypatch, sizes):
    for k, x in sizes.items():
        monkeypatch.setattr(graph, k, x)
    links, names, up = ladder(6)
    pairs = [(a, b) for a in names[::4] for b in names[1::6]] + [("t1", "t2"), ("t3", "t4"), ("u1", "u2"), ("u1", "u1"), ("t5", "t6"), ("t6", "m09"), ("m05", "m28"), ("none", "t1")]
    ids = spark.createDataFrame([(n,) for n in names], "id string")
    g = graph.Graph(ids, spark.createDataFrame(links, "src string, dst string, ord int"))
    want = set()
    for a, b in pairs:
        both = reach(a, up) & reach(b, up) & set(names)
        want |= {(f"{a}-{b}", c) for c in both if not any(c in reach(x, up) and x not in reach(c, up) for x in both)}
    got = rows(g.common_ancestors(spark.createDataFrame([(f"{a}-{b}", f" {a.upper()}", b) for a, b in pairs], "pair string, left_id string, right_id string")))
    assert set(got) == want and len(got) == len(want)


def test_long_loops_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph.Graph, "reach", None)
    links = [(f"o{i:04d}", f"o{(i + 1) % 1500:04d}", 0) for i in range(1500)] + [("a", "o0000", 0), ("b", "o0700", 0), ("b", "a", 1)]
    g = graph.Graph(spark.createDataFrame([(x,) for x, _, _ in links], "id string"), spark.createDataFrame(links, "src string, dst string, ord int"))
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "o0003", "b")], "pair string, left_id string, right_id string")
    got = rows(g.common_ancestors(pairs))
    assert got == [("p", "a")] + [("q", f"o{i:04d}") for i in range(1500)]


@pytest.mark.parametrize("base_rows", [0, 3, 1000])
def test_connected_parts(spark, base_rows):
    rnd = random.Random(3)
    links = [(rnd.randrange(60), rnd.randrange(60, 120)) for _ in range(50)] + [(200, x) for x in range(130, 150)]
    label = {x: x for p in links for x in p}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(rows(graph.connected(spark.createDataFrame(links, "a long, b long"), base_rows)))
    assert set(got) == set(label)
    assert len(set(got.values())) == len(set(label.values())) == len(set(zip((got[x] for x in label), label.values())))


@pytest.mark.parametrize("sizes", SIZES)
def test_passes_of_blocks(spark, monkeypatch, sizes):
    for k, x in sizes.items():
        monkeypatch.setattr(graph, k, x)
    if "WHOLE_LINKS" not in sizes:
        monkeypatch.setattr(graph.Graph, "reach", None)
    links, names, up = ladder(6)
    pairs = [(a, b) for a in names[::4] for b in names[1::6]] + [("t3", "m03"), ("u1", "u1"), ("t4", "o000"), ("t0", "o004"), ("t6", "t5"), ("m09", "m00"), ("none", "t1")]
    marked = ["o002", "m10", "t3", "t5", "u2", "gone"]
    ids = spark.createDataFrame([(n,) for n in names], "id string")
    g = graph.Graph(ids, spark.createDataFrame(links, "src string, dst string, ord int"))
    df = spark.createDataFrame([(f"{a}-{b}", a, f"{b.upper()} ") for a, b in pairs], "pair string, left_id string, right_id string")
    got = rows(g.passes(df, spark.createDataFrame([(m,) for m in marked], "id string")))
    assert got == sorted(((f"{a}-{b}", a in names and any(m in reach(a, up) and b in reach(m, up) for m in marked)) for a, b in pairs), key=repr)
