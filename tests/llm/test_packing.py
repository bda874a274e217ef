import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import packing, tokens

SIZES = "container_kind string, capacity_tokens int, doc_id int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]))
def test_every_constraint_holds(sizes, by):
    sizes = np.sort(np.array(sizes, int))[::-1]
    bins = packing.best_fit(sizes, 100, 4, 100.0**2 * 0.6, by)
    for b in np.unique(bins):
        inside = sizes[bins == b]
        assert inside.sum() <= 100 and len(inside) <= 4
        assert (inside**2).sum() <= 6000 or len(inside) == 1
    if len(sizes):  # no two bins could be one: each is opened only if nothing fits
        assert len(np.unique(bins)) == bins.max() + 1


def test_fills_well():
    sizes = np.sort(np.random.default_rng(1).integers(1, 900, 3000))[::-1]
    bins = packing.best_fit(sizes, 2048, 64, 2048.0**2)
    assert sizes.sum() / (2048 * (bins.max() + 1)) > 0.97


def check(contents, counts, sizes):
    for kind, cap in sizes:
        got = [r for r in contents if r["container_kind"] == kind]
        held = {}
        for r in got:
            if r["container_id"] is not None:
                held[r["container_id"]] = held.get(r["container_id"], 0) + r["token_to"] - r["token_from"]
        for r in got:
            if r["container_id"] is not None:
                assert held[r["container_id"]] == r["container_tokens"] <= cap and r["unused_tokens"] == cap - r["container_tokens"]
        for doc, n in counts.items():
            mine = sorted((r["token_from"], r["token_to"]) for r in got if r["doc_id"] == doc)
            assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
            assert len(mine) == (1 if n <= cap else -(-n // cap))


def test_packs_every_text_whole(spark):
    docs = [(i, "word " * n, "clash") for i, n in enumerate([0, 1, 3, 4, 5, 9, 23, 7, 7, 7, 2, 60])] + [(50, None, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, container_kind string")
    sizes = [("s", 8), ("l", 32)]
    s = spark.createDataFrame([(k, c, 1) for k, c in sizes] + [("bad", None, 1), ("none", 0, 1)], SIZES)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.with_tokens(d).collect()}
    assert counts[0] == counts[50] == 0 and counts[1] == 2
    for block, by in ((4096, "norm"), (3, "dot")):
        got = packing.pack_documents(d, s, block, by)
        check(got.collect(), counts, sizes)
        report = {r["container_kind"]: r for r in packing.fill_report(got, s).collect()}
        assert set(report) == {"s", "l"} and report["s"]["tokens"] == sum(counts.values()) and report["s"]["texts_without_tokens"] == 2 and report["s"]["texts"] == 11


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    s = spark.createDataFrame([("s", 8, 1)], SIZES)
    assert packing.pack_documents(d, s).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), s.limit(0)).count() == 0


def test_tokens_round_trip():
    import base64
    import os

    import tiktoken

    with open(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("The \\emph{end}", "café 中 <|endoftext|>", " \n\t x" * 50):
        assert e.decode(e.encode_ordinary(t)) == t
