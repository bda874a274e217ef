import random

from chronofold.llm import subjects as s

AREAS = ["plants", "stars", "cooking", "sailing", "music", "weaving"]
WORDS = {a: [a[:3] + x + y for x in ("ba", "do", "ki", "lu", "me") for y in ("ran", "sol", "tik", "vum", "wex", "zor")] for a in AREAS}
COMMON = "we see how the of and in this with that for is to".split()


def corpus(seed, n):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main, other = rnd.sample(list(WORDS), 2)
        mixed = i % 7 == 0
        sents = []
        for k in range(8):
            area = other if mixed and k % 2 else main
            if k == 5:
                sents.append("The rest of this is left for the others.")
            else:
                sents.append(" ".join(rnd.sample(COMMON, 4) + rnd.sample(WORDS[area], 3)).capitalize() + ".")
        docs.append((i, r"\begin{document}" + " ".join(sents) + r"\end{document}", "x"))
        truth[i] = {main, other} if mixed else {main}
    return docs, truth


def test_finds_areas(spark):
    docs, truth = corpus(1, 240)
    docs += [(900, None, "x"), (901, "", "x"), (902, "% nothing", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    labels = [(i, next(iter(truth[i])), 1) for i in range(0, 90, 2)] + [(1, "unknown", 1), (5000, "stars", 1), (3, "Stars", 2), (None, None, None)]
    la = spark.createDataFrame(labels, "doc_id long, subject string, labeler int")
    su = spark.createDataFrame([("Plants ", "d"), *[(a, "d") for a in AREAS], (None, None)], "subject string, description string")
    found = s.document_subjects(d, la, su)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
        assert 4 * r["n_sentences"] >= r["n_treated"]
    held_out = [i for i in truth if i >= 90 or i % 2]
    assert sum(got.get(i) == truth[i] for i in held_out) >= 0.9 * len(held_out)
    assert not {900, 901, 902} & set(got)
    shares = {r["subject"]: r["doc_share"] for r in s.composition(found).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-6


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    la = spark.createDataFrame([], "doc_id long, subject string, labeler int")
    su = spark.createDataFrame([("stars", "d")], "subject string, description string")
    assert s.document_subjects(d, la, su).count() == 0
    assert s.document_subjects(d, la, su.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "The orbit of the comet is this.")], "doc_id long, text string")
    assert s.document_subjects(one, la, su).count() == 0


def test_finds_areas_without_labels_in_a_language(spark):
    docs, truth = corpus(3, 240)
    rnd, french = random.Random(4), "nous voyons que la les des et une pour dans avec est".split()
    for i in range(1000, 1120):
        area = AREAS[i % 6]
        own = [w + "eux" for w in WORDS[area][:12]] + ["q" + w for w in WORDS[area]]  # some akin to the other language's words
        sents = [" ".join(rnd.sample(french, 5) + rnd.sample(own, 3)).capitalize() + "." for _ in range(8)]
        docs.append((i, r"\begin{document}" + " ".join(sents) + r"\end{document}", "x"))
        truth[i] = {area}
    # labels of languages may be wrong, missing or written otherwise
    label = lambda i: rnd.choice([None, "EN ", "fr"]) if i % 10 == 3 else "fr" if i >= 1000 else "en"
    d = spark.createDataFrame([(*x, label(x[0])) for x in docs], "doc_id long, text string, subject string, lang string")
    hidden = {"stars": set(range(1000, 1120)), "weaving": set(truth)}  # no French label; no label at all
    labels = [(i, a, 1) for i in truth if i % 2 == 0 or i >= 1000 for a in truth[i] if i not in hidden.get(a, ())]
    su = [(a, "things " + " ".join(WORDS[a][:6] if a == "weaving" else [])) for a in AREAS]
    found = s.document_subjects(d, spark.createDataFrame(labels, "doc_id long, subject string, labeler int"), spark.createDataFrame(su, "subject string, description string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    for area, ids in (("stars", range(1000, 1120)), ("weaving", range(1000, 1120)), ("weaving", range(240))):
        these = [i for i in ids if area in truth[i]]
        assert sum(area in got.get(i, ()) for i in these) >= 0.9 * len(these)
        others = [i for i in ids if area not in truth[i]]
        assert sum(area in got.get(i, ()) for i in others) <= 0.05 * len(others)


def test_subjects_come_from_vectors_and_centroids(spark):
    docs, truth = corpus(5, 120)
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    la = spark.createDataFrame([(i, next(iter(truth[i])), 1) for i in range(0, 120, 2)], "doc_id long, subject string, labeler int")
    table = s.document_terms(d)
    model = s.fit(table, la, sorted(AREAS))
    batch = table.toArrow().combine_chunks().to_batches()[0]
    right = s._sentence_counts(batch, model).argmax(axis=1)
    model.centroids = model.centroids[:, ::-1]
    assert (s._sentence_counts(batch, model).argmax(axis=1) == len(AREAS) - 1 - right).mean() > 0.9


def test_too_many_subjects_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(s, "MOST_SUBJECTS", 2)
    with pytest.raises(ValueError):
        s.subject_names(spark.createDataFrame([(a, "d") for a in AREAS], "subject string, description string"))
