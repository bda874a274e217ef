import datetime as dt
import random

from conftest import rows

from chronofold.operators import snapshots, versions

COMMITS = "commit_id string, line string, tree string, parents array<string>, committer_ts long, received_at timestamp, extra string"
REFS = "tree string, ref_type string, parent_path string, ref_name string, object_id string, metadata_id string, minx double, listed_at timestamp, line string"
T = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=i) for i in range(50)]


def ids(n):
    return f"{n:040x}"


def tables(spark, commits, refs):
    c = [(ids(k), line, ids(tree), None, ts, T[0], "x") for k, line, tree, ts in commits]
    r = [(ids(tree), "FEATURE", p, n, o, m, None, T[0], "clash") for tree, p, n, o, m in refs]
    return spark.createDataFrame(c, COMMITS), spark.createDataFrame(r, REFS)


def brute(commits, refs):
    tree = {}
    for t, p, n, o, m in refs:
        tree.setdefault(t, {})[p, n] = (o, m)
    lines = {}
    for k, line, t, ts in commits:
        if t in tree:
            lines.setdefault(line, []).append((ts, ids(k), t))
    vers, changes = [], []
    for line, s in lines.items():
        s.sort()
        for key in {x for _, _, t in s for x in tree[t]}:
            seen = [tree[t].get(key) for _, _, t in s]
            for i, v in enumerate(seen):
                if v is not None and (i == 0 or seen[i - 1] != v):
                    j = i
                    while j + 1 < len(s) and seen[j + 1] == v:
                        j += 1
                    vers.append((line, *key, s[i][0], s[j + 1][0] if j + 1 < len(s) else -1))
                if i and (v is None) != (seen[i - 1] is None):
                    changes.append((s[i][1], *key, "REMOVED" if v is None else "ADDED"))
                elif i and v is not None and v[0] != seen[i - 1][0]:
                    changes.append((s[i][1], *key, "MODIFIED"))
    return sorted(vers, key=repr), sorted(changes, key=repr)


def case(seed):
    rnd = random.Random(seed)
    commits = [(i + 1, f"l{i % 3}", 1000 + rnd.randrange(14), 100 * i + rnd.randrange(90)) for i in range(30)]
    refs = [(1000 + t, p, n, ids(rnd.randrange(3) + 1), rnd.choice([None, ids(77)])) for t in range(11) for p in ("", "a") for n in ("x", "y", "z") if rnd.random() < 0.6]
    return commits, refs


def test_versions_and_changes_against_brute_force(spark):
    for seed in range(3):
        commits, refs = case(seed)
        c, r = tables(spark, commits, refs)
        vers, changes = brute(commits, refs)
        assert rows(versions.feature_versions(c, r)) == vers
        assert rows(snapshots.snapshot_changes(c, r)) == changes


def test_dirty_rows(spark):
    c = spark.createDataFrame(
        [(" " + ids(1).upper(), "l", ids(11), None, 1, T[0], ""), (ids(1), "l", ids(11), None, 1, T[5], ""), (ids(2), "l", ids(12) + " ", None, 2, T[0], ""),
         (ids(3), "l", None, None, 3, T[0], ""), (None, "l", ids(12), None, 4, T[0], ""), (ids(5), None, ids(12), None, 5, T[0], ""), (ids(6), "l", ids(99), None, 6, T[0], "")],
        COMMITS,
    )
    zero = "0" * 40
    r = spark.createDataFrame(
        [(ids(11), "FEATURE", "", "a", ids(1), None, None, T[1], ""), (ids(11), "FEATURE", "", "a", ids(2), None, None, T[2], ""), (ids(11), "FEATURE", "", "a", ids(2), zero, None, T[2], ""),
         (ids(12).upper(), "FEATURE", "", "a", ids(2).upper(), zero, None, None, ""), (ids(11), "FEATURE", None, None, None, None, None, T[1], ""), (ids(12), "FEATURE", None, None, None, None, None, T[1], ""),
         (ids(11), "FEATURE", "", "t", ids(1), None, None, T[1], ""), (ids(11), "TREE", "", "t", ids(1), None, None, T[3], "")],
        REFS,
    )
    assert rows(versions.feature_versions(c, r)) == [("l", "", "a", 1, -1), ("l", None, None, 1, -1)]
    assert rows(snapshots.snapshot_changes(c, r)) == []


def test_empty(spark):
    c, r = spark.createDataFrame([], COMMITS), spark.createDataFrame([], REFS)
    assert rows(versions.feature_versions(c, r)) == [] and rows(snapshots.snapshot_changes(c, r)) == []


def test_merging_in_turn_equals_merging_at_once(spark):
    commits, refs = case(5)
    c, r = tables(spark, commits, refs)
    snaps, n = snapshots.snapshots(c, r)
    placed = snapshots.placed(r, snaps, n, snapshots.object_hash())
    keys = ["first_num", *snapshots.PATH]
    whole = versions.merge_versions(None, placed, keys)
    snaps = snaps.withColumn("k", snaps["num"] - snaps["first_num"])
    early = placed.filter("num - first_num < 4")
    known = snaps.filter("k < 4").selectExpr("num", "case when k < 3 then next_ts else -1 end as next_ts")
    first = versions.merge_versions(None, early.drop("next_ts").join(known, "num"), keys)
    late, periods = placed.filter("num - first_num >= 4"), snaps.select("num", "next_ts")
    second = versions.merge_versions(first, late, keys, periods)
    assert rows(second.select(sorted(whole.columns))) == rows(whole.select(sorted(whole.columns)))
    # without a new row, the merge only closes what has been followed by another period
    closed = versions.merge_versions(first, late.limit(0), keys, periods)
    assert closed.count() == first.count() and closed.filter("valid_to = -1").count() == first.filter("valid_to = -1").join(periods.filter("next_ts = -1").selectExpr("num as last_num"), "last_num").count()
    for turns in (1, 3, 50):
        assert rows(versions.feature_versions(c, r, turns)) == rows(versions.feature_versions(c, r))


def test_numbers_follow_the_order(spark, monkeypatch):
    from chronofold import workspace

    d = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k long, v string")
    for entries in (256, 1):
        monkeypatch.setattr(workspace, "MAP_ENTRIES", entries)
        got, n = workspace.number_rows(d, ["k"], "num")
        assert n == 101 and rows(got.select("k", "num")) == [(i, i) for i in sorted(range(101), key=lambda i: repr((i, i)))]
    assert workspace.number_rows(d.limit(0), ["k"], "num")[1] == 0
