from conftest import rows

from chronofold.llm import mixing

TARGETS = "source string, target_share double, max_repeats int, n_tokens int"


def docs(spark, sizes):
    out = [(1000 * k + i, name, n) for k, (name, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    return spark.createDataFrame(out, "doc_id long, source string, n_tokens long")


def test_shares_repeats_and_nesting(spark):
    d = docs(spark, {"a": [10] * 400, "b": [7, 13] * 50, "c": [5] * 20, "other": [9] * 5})
    t = spark.createDataFrame([(" A ", 0.5, 1, 0), ("B", 0.3, 2, 0), ("c", 0.1, 4, 0), ("gone", 0.1, 9, 0), (None, 0.5, 1, 0)], TARGETS)
    report = {r["source"]: r for r in mixing.mix_report(None, t, tokens=d).collect()}
    assert report["gone"]["mix_tokens"] == 0 and "other" not in report
    whole = sum(r["mix_tokens"] for r in report.values())
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(report[s]["mix_tokens"] - share * whole) <= 20 and abs(report[s]["actual_share"] - share) < 0.01
    assert report["c"]["mix_tokens"] == 4 * 100  # the source that limits the mix gives all it may
    last = None
    for total in (500, 1500, 3000):
        mix = {r["doc_id"]: r for r in mixing.mix_documents(None, t, total, tokens=d).collect()}
        assert abs(sum(r["n_tokens"] * r["copies"] for r in mix.values()) - total) <= 40
        assert all(r["copies"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in mix.values())
        assert last is None or all(mix[k]["copies"] >= c for k, c in last.items())
        last = {k: r["copies"] for k, r in mix.items()}


def test_more_than_there_is(spark):
    d = docs(spark, {"a": [10] * 10, "b": [10] * 10})
    t = spark.createDataFrame([("a", 0.9, 1, 0), ("b", 0.1, 3, 0)], TARGETS)
    got = {r["source"]: r["mix_tokens"] for r in mixing.mix_report(None, t, 250, tokens=d).collect()}
    assert got["a"] == 100 and abs(got["b"] - 150) <= 10
    got = {r["source"]: r["mix_tokens"] for r in mixing.mix_report(None, t, 10_000, tokens=d).collect()}
    assert got == {"a": 100, "b": 300}


def test_thresholds_against_sorting(spark):
    d = docs(spark, {"a": [3, 50, 1, 8] * 60})
    t = spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    for total in (1, 40, 777, 2000):
        counted, quotas = mixing.plan_mix(None, t, total, tokens=d)
        hashed = sorted((r["h"], r["n_tokens"]) for r in counted.collect())
        taken = sum(n for h, n in hashed if h < quotas["a"].below)
        assert min(abs(total - sum(n for _, n in hashed[:k])) for k in range(len(hashed) + 1)) <= abs(total - taken) <= 50


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    assert rows(mixing.mix_documents(None, t, tokens=docs(spark, {}))) == []
    assert rows(mixing.mix_documents(None, t.limit(0), tokens=docs(spark, {"a": [1]}))) == []
    full = spark.createDataFrame([(1, None, "a b"), (2, "a", None), (3, " A", "a b c")], "doc_id long, source string, text string")
    assert [tuple(r)[:2] for r in rows(mixing.mix_documents(full, t))] in ([(3, "a")], [(2, "a"), (3, "a")])
