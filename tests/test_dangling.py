import datetime as dt
import random

import numpy as np
from conftest import rows

from chronofold.operators import dangling as d

T = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
C = "commit_id string, tree string, parents array<string>, received_at timestamp, id string"
O, B, D = "id string, received_at timestamp, status string", "id string", "id string, deleted_at timestamp"


def test_bitmaps_round_trip():
    for n in (0, 1, 4096, 4097, 65536):
        x = np.sort(np.random.default_rng(n).choice(65536, n, replace=False))
        assert (d.unpack(d.pack(x)) == x).all()
    assert len(d.pack(np.arange(60000))) == 8193


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"{i:040x}" for i in range(1, 60)] + ["odd id", "x" * 20]
    commits = [(f"{1000 + rnd.randrange(40):040x}", rnd.choice([None, *pool]), rnd.choice([None, [], [rnd.choice(pool), None], [rnd.choice(pool), "0" * 40]]), T(rnd.randrange(100)), "q") for _ in range(120)]
    puts = [(rnd.choice(pool[:45]).upper(), T(rnd.randrange(100)), "s") for _ in range(60)]
    dels = [(rnd.choice(pool), T(rnd.randrange(120))) for _ in range(25)]
    base = [(p,) for p in pool[40:48]]
    first, refs = {}, set()
    for c, t, ps, at, _ in commits:
        first[c] = min(first.get(c, at), at)
        refs |= {(c, "tree", t)} | {(c, "parents", p) for p in ps or []}
    want = []
    for c, f, k in refs:
        if k is None or k == "0" * 40 or (k,) in base:
            continue
        put = [t for i, t, _ in puts if i.lower() == k]
        gone = [t for i, t in dels if i == k]
        if not put:
            want.append((c, f, k, "missing"))
        elif gone and max(gone) > max(put):
            want.append((c, f, k, "deleted"))
        elif min(put) > first[c]:
            want.append((c, f, k, "late"))
    args = [spark.createDataFrame(x, s) for x, s in ((commits, C), (puts, O), (base, B), (dels, D))]
    found = d.dangling_references(*args)
    assert rows(found.drop("period")) == sorted(want, key=repr)
    assert sum(r["n_refs"] for r in d.dangling_counts(found).collect()) == len(want)


def test_empty(spark):
    c, o, b, x = (spark.createDataFrame([], s) for s in (C, O, B, D))
    assert rows(d.dangling_references(c, o, b, x)) == []
    c = spark.createDataFrame([("c", "t", None, None, "")], C)
    assert rows(d.dangling_references(c, o, b, x).drop("period")) == [("c", "tree", "t", "missing")]


def test_status_comes_from_the_bitmaps(spark, monkeypatch):
    here, gone, late, lost = (f"{i:040x}" for i in range(1, 5))
    commits = spark.createDataFrame([("c", here, [gone, late, lost], T(50), "")], C)
    objects = spark.createDataFrame([(here, T(1), ""), (gone, T(1), ""), (late, T(200), "")], O)
    args = commits, objects, spark.createDataFrame([], B), spark.createDataFrame([(gone, T(2))], D)
    want = [("c", "parents", gone, "deleted"), ("c", "parents", late, "late"), ("c", "parents", lost, "missing")]
    assert rows(d.dangling_references(*args).drop("period")) == want
    monkeypatch.setattr(d, "unanswered", lambda references, parents: spark.createDataFrame([], "code long, period int, ref_field string, status string"))
    assert rows(d.dangling_references(*args)) == []


def test_unknown_times(spark):
    a, b = "a" * 40, "b" * 40
    c = spark.createDataFrame([("c", a, [b], None, ""), ("d", a, [b], T(5), "")], C)
    o = spark.createDataFrame([(a, None, ""), (b, T(9), "")], O)
    assert rows(d.dangling_references(c, o, spark.createDataFrame([], B), spark.createDataFrame([(a, None)], D)).drop("period")) == [("d", "parents", b, "late")]
