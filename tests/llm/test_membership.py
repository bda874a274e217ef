import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from chronofold.llm import membership as m

PUTS, BASE = "put_seq long, id string, kind string, batch int", "id string, put_seq long"


def test_sealed_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    h, s = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    sealed = m.Sealed(np.r_[h, h[:3]], np.r_[s, s[:3] + 1])
    assert sorted(sealed.slots(h)) == list(range(5000)) and sealed.seen(h, s).all() and sealed.seen(h[:3], s[:3] + 1).all()
    other = rng.integers(0, 2**63, 100000).astype(np.uint64)
    assert sealed.seen(other, other).mean() < 10 / 2**16
    assert len(sealed.dump()) < 4 * 5000
    back = m.Sealed.load(sealed.dump())
    assert (back.slots(other) == sealed.slots(other)).all() and back.seen(np.r_[h, h[:3]], np.r_[s, s[:3] + 1]).all() and (back.seen(other, other) == sealed.seen(other, other)).all()
    none = m.Sealed(h[:0], s[:0])
    assert not none.seen(h, s).any()


def test_against_brute_force(spark):
    for seed, bits in ((1, 16), (2, 2)):
        rnd = random.Random(seed)
        pool = [f"{i:040x}" for i in range(1, 120)]
        puts = [(s, rnd.choice([rnd.choice(pool), pool[0], None, "0" * 40, rnd.choice(pool).upper() + " "]), "x", 9) for s in rnd.sample(range(10_000), 300)]
        base = [(" " + p, 5) for p in pool[:10]] + [(None, 1)]
        seen, want = {p for p in pool[:10]}, []
        for s, i, *_ in sorted(puts, key=lambda p: p[0]):
            key = (i or "").strip().lower()
            if not key or key == "0" * 40:
                continue
            if key in seen:
                want.append((s,))
            seen.add(key)
        p, b = spark.createDataFrame(puts, PUTS), spark.createDataFrame(base, BASE)
        assert rows(m.seen_before(p, b, bits=bits)) == sorted(want, key=repr)
        cut = p.withColumn("batch", F.expr("put_seq div 1000"))
        new = m.seen_in_new_batch(cut.filter("batch < 7"), cut.filter("batch >= 7"), b, bits)
        assert rows(new) == sorted([w for w in want if w[0] >= 7000], key=repr)
        r = m.wrong_answers(p, b, bits=bits).first()
        if bits == 2:
            assert r["wrong_answers"] > 0 and 0 < r["expected_rate"] < 1
        else:
            assert r["wrong_answers"] == 0


def test_empty(spark):
    none, nobase = spark.createDataFrame([], PUTS), spark.createDataFrame([], BASE)
    assert rows(m.seen_before(none, nobase)) == []
    assert m.wrong_answers(none, nobase).first()["wrong_rate"] == 0
    one = spark.createDataFrame([(1, "a" * 40, "x", 0), (2, "a" * 40, "x", 0)], PUTS)
    assert rows(m.seen_before(one, nobase)) == [(2,)]


def test_far_off_number_and_hot_key(spark):
    hot = "f" * 40
    puts = [(i, hot if i % 3 == 0 else f"{i:040x}", "x", 0) for i in range(3000)] + [(10**15, "e" * 40, "x", 0), (10**15 + 1, f"{1:040x}", "x", 0)]
    p, b = spark.createDataFrame(puts, PUTS), spark.createDataFrame([], BASE)
    at = p.withColumn("n", m.batches_of(p)).groupBy("n").count()
    assert at.count() == m.BATCHES and max(r["count"] for r in at.collect()) < 500
    assert {r[0] for r in m.seen_before(p, b).collect()} == {i for i in range(1, 3000) if i % 3 == 0} | {10**15 + 1}


def test_answers_come_from_the_sealed_partitions(spark, monkeypatch):
    puts = [(i, f"{1 + i % 40:040x}", "x", 0) for i in range(80)]
    p, b = spark.createDataFrame(puts, PUTS), spark.createDataFrame([], BASE)
    assert m.seen_before(p, b, batches=2).count() == 40
    looked, stored = m.walk(m.hashed(p, b, m.batches_of(p, 2), 4), 4)
    assert stored.agg(F.sum("n_keys")).first()[0] == 80 and {r["hits"] for r in looked.filter("put_seq >= 40").collect()} == {1}
    blind = looked.withColumn("hits", F.lit(0))
    assert m.claims_checked(p, b, blind).count() == 0
