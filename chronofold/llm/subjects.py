"""Subject areas of documents: term weighting, truncated singular value decomposition, refined seed centroids.

1. Every document's visible prose becomes sentences of hashed terms. The languages are those that documents are
   labelled with; as labels may be missing or wrong, a document's own is the one whose labelled documents use
   its words most. Terms of different languages are kept apart, and weighted by inverse document frequency
   within their language.
2. A truncated singular value decomposition of the document-term matrix, by randomized subspace iteration
   over all documents, embeds terms, and with them documents and sentences, in ``DIMENSIONS`` dimensions.
3. Labelled documents seed a centroid for each subject and language. A subject without labels in a language is
   seeded by that language's terms that begin like terms near the subject's centroids of other languages, or,
   without labels anywhere, like words of its description. Documents go to the nearest centroid by cosine
   similarity and centroids are recomputed, a few times.
4. The documents' similarities tell how terms are spread over subjects; a term spread like the documents
   themselves says nothing, one found in one subject alone says most, and terms are weighted by that too.
   Each sentence is the weighted sum of its terms' vectors; one of enough weight treats the subject of the
   centroid of its language to which it has the largest cosine similarity.

All matrices have ``FEATURES`` rows, whatever the corpus; only they and sums of them come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import discard, materialize
from . import latex

FEATURES = 1 << 16
DIMENSIONS, OVERSAMPLED = 48, 16
#: A term in more than this share of its language's documents carries no subject.
COMMON = 0.25
#: Inverse document frequencies above this count as this much; rare terms aren't worth more.
MOST = 4.0
#: Weight of subject-bearing terms from which a sentence treats an area.
LEAST_WEIGHT = 1.2
#: Share of the treated sentences that an area needs.
QUARTER = 4
#: Occurrences of the language's average that every term is mixed with, against chance.
SMOOTH = 3.0
ROUNDS = 3
#: Letters by which words of different languages are held to be akin, and the least lead of a subject in cosine
#: over the next one at which such a beginning speaks for it.
BEGINNING = 5
LEAD = 0.1
#: Subjects that may be asked for; more are an error.
MOST_SUBJECTS = 1000
#: Labels of languages that are told apart, the most frequent ones; documents of others go by their words.
LANGUAGES = 64

TERMS = "doc_id long, label string, words long, lens array<int>, terms array<int>, uterms array<int>, ucounts array<int>, vterms array<int>, vcues array<int>"


def _cue(word: bytes) -> int | None:
    """The beginning of a word, hashed alike in all languages; short words have none."""
    import zlib

    start = word[:BEGINNING] if word.isascii() else word.decode()[:BEGINNING].encode()
    return zlib.crc32(start) % FEATURES if len(start) >= BEGINNING else None


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences as hashes of words, and the document's distinct hashes with their counts.

    ``vterms`` and ``vcues`` are the words that the task meets first among documents of one label, with their beginnings.
    """
    import zlib
    from collections import Counter
    from itertools import chain

    ids: dict[bytes, int] = {}
    known: dict[str | None, set[bytes]] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            words, lens, terms, uterms, ucounts, vterms, vcues = [], [], [], [], [], [], []
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                found = latex.sentences(text)
                flat = list(chain.from_iterable(found))
                counted = Counter(flat)
                if len(ids) > 1_000_000:
                    ids.clear()
                    known.clear()
                met = known.setdefault(label, set())
                fresh, cues = [], []
                for w in counted:
                    if w not in ids:
                        h = zlib.crc32(w)
                        ids[w] = h - (h >> 31 << 32)  # as a signed number
                    if w not in met:
                        met.add(w)
                        if (cue := _cue(w)) is not None:
                            fresh.append(ids[w])
                            cues.append(cue)
                vterms.append(np.array(fresh, np.int32))
                vcues.append(np.array(cues, np.int32))
                words.append(len(flat))
                lens.append(np.fromiter(map(len, found), np.int32, len(found)))
                terms.append(np.fromiter(map(ids.__getitem__, flat), np.int32, len(flat)))
                uterms.append(np.fromiter(map(ids.__getitem__, counted), np.int32, len(counted)))
                ucounts.append(np.fromiter(counted.values(), np.int32, len(counted)))
            arrays = [part.column(0), part.column(2), pa.array(words, pa.int64())]
            arrays += [pa.array(x, pa.list_(pa.int32())) for x in (lens, terms, uterms, ucounts, vterms, vcues)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "words", "lens", "terms", "uterms", "ucounts", "vterms", "vcues"])


def document_terms(docs: DataFrame) -> DataFrame:
    label = F.lower(F.btrim("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.when(label != "", label).alias("label")).mapInArrow(_terms, TERMS)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return col.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum ``rows`` by ``index``."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(first):
        out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _by_parts(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum consecutive rows in parts of the given lengths; empty parts give zeros."""
    out = np.zeros((len(lens), values.shape[1]), values.dtype)
    some = lens > 0
    if len(values):
        out[some] = np.add.reduceat(values, (np.cumsum(lens) - lens)[some], axis=0)
    return out


@dataclass
class Languages:
    """The languages told apart, and how their documents use words: a row of log frequencies for each feature."""

    names: list[str]
    logs: np.ndarray

    def of(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The language of each document of ``n`` distinct words: the likeliest by its words, the first without any."""
        if len(self.names) < 2:
            return np.zeros(len(n), np.int32)
        return _by_parts(self.logs[_feature(term, 0)], n).argmax(axis=1).astype(np.int32)

    def features(self, term: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Features of words by the language of their documents."""
        return _feature(term, self.salts()[lang])

    def salts(self) -> np.ndarray:
        import zlib

        return np.array([zlib.crc32(x.encode()) for x in self.names], np.uint32)


def _feature(term: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = (term.view(np.uint32) ^ np.asarray(salt, np.uint32)) * np.uint32(2654435761)
    return (x >> np.uint32(16)).astype(np.int64)


@dataclass
class Weighted:
    """A batch's documents as rows of the weighted, normalised document-term matrix."""

    lang: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, idf: np.ndarray, langs: Languages) -> Weighted:
        word, n = _lists(batch.column("uterms"))
        count, _ = _lists(batch.column("ucounts"))
        doc = np.repeat(np.arange(len(n)), n)
        lang = langs.of(word, n)
        term = langs.features(word, lang[doc])
        w = idf[term]
        keep = w > 0
        doc, term, w = doc[keep], term[keep], (1 + np.log(count[keep])).astype(np.float32) * w[keep]
        norm = np.sqrt(np.bincount(doc, w * w, minlength=len(n)))
        return cls(lang, doc, term, (w / np.maximum(norm[doc], 1e-9)).astype(np.float32))

    def times(self, q: np.ndarray) -> np.ndarray:
        return _by_parts(q[self.term] * self.weight[:, None], np.bincount(self.doc, minlength=len(self.lang)))

    def add_gram(self, q: np.ndarray, out: np.ndarray) -> None:
        """Add the matrix's transpose times itself times ``q``: by dense blocks of documents where terms recur, else by entries."""
        edges = np.searchsorted(self.doc, np.arange(0, len(self.lang) + 500, 500))
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            doc, term, weight = self.doc[i:j] - 500 * k, self.term[i:j], self.weight[i:j]
            used, col = np.unique(term, return_inverse=True)
            if 500 * len(used) <= 64 * len(term):
                block = np.zeros((500, len(used)), np.float32)
                np.add.at(block, (doc, col), weight)
                out[used] += block.T @ (block @ q[used])
            elif len(term):
                y = _by_parts(q[term] * weight[:, None], np.bincount(doc, minlength=500))
                out[used] += _sums(col, y[doc] * weight[:, None], len(used))


def _reduce(table: DataFrame, columns: list[str], width: int, rows: int, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of ``part``'s ``rows`` x ``width`` matrix.

    A few partial matrices are made for each core of the cluster, however many files the table has; they are
    added up by groups of rows, and the driver receives the sum alone.
    """
    spark = table.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = part(batches)
        at = np.flatnonzero(got.any(axis=1)).astype(np.int32)
        values = pa.FixedSizeListArray.from_arrays(pa.array(got[at].astype(np.float32).ravel()), width).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(at), values], names=["i", "v"])

    partial = table.select(*columns).coalesce(4 * max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "i int, v array<float>")

    def add(t: pa.Table) -> pa.Table:
        i, v = t.column("i").to_numpy(), np.concatenate([c.flatten().to_numpy() for c in t.column("v").chunks]).reshape(-1, width)
        u, inverse = np.unique(i, return_inverse=True)
        s = _sums(inverse, v, len(u))
        return pa.table({"i": u, "v": pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), width).cast(pa.list_(pa.float32()))})

    total = partial.groupBy(F.pmod("i", F.lit(64)).alias("g")).applyInArrow(add, "i int, v array<float>").toArrow()
    out = np.zeros((rows, width), np.float32)
    if total.num_rows:
        out[total.column("i").to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in total.column("v").chunks]).reshape(-1, width)
    return out


def languages(table: DataFrame) -> Languages:
    """The languages of the labels, with the share of their documents that use each word."""
    counted = table.filter("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES)
    names = sorted(r["label"] for r in counted.collect())
    if len(names) < 2:
        return Languages(names or [""], np.zeros((0, 1), np.float32))

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, at = np.zeros((FEATURES + 1, len(names)), np.float32), {x: i for i, x in enumerate(names)}
        for b in batches:
            word, n = _lists(b.column("uterms"))
            lang = np.array([at.get(x, -1) for x in b.column("label").to_pylist()], np.int64)
            of, f = np.repeat(lang, n), _feature(word, 0)
            out[:-1] += np.bincount((f * len(names) + of)[of >= 0], minlength=FEATURES * len(names)).reshape(-1, len(names))
            out[-1] += np.bincount(lang[(lang >= 0) & (n > 0)], minlength=len(names))
        return out

    df = _reduce(table, ["label", "uterms"], len(names), FEATURES + 1, part)
    return Languages(names, np.log((df[:-1] + 0.5) / (df[-1] + 1)).astype(np.float32))


def _idf(table: DataFrame, langs: Languages) -> np.ndarray:
    """Inverse document frequency of every term within its language."""
    n_langs = len(langs.names)

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((FEATURES + 1, n_langs), np.float32)
        for b in batches:
            word, n = _lists(b.column("uterms"))
            lang = langs.of(word, n)
            of = np.repeat(lang, n)
            out[:-1] += np.bincount(of + n_langs * langs.features(word, of), minlength=FEATURES * n_langs).reshape(-1, n_langs)
            out[-1] += np.bincount(lang[n > 0], minlength=n_langs)
        return out

    df = _reduce(table, ["uterms"], n_langs, FEATURES + 1, part)
    of, df = df[-1], df[:-1]
    most, n = df.max(axis=1), of[df.argmax(axis=1)]
    idf = np.where((most >= 2) & (most <= np.maximum(COMMON * n, 2)), np.log(np.maximum(n, 1) / np.maximum(most, 1)), 0)
    return idf.clip(0, MOST).astype(np.float32)


def _svd(table: DataFrame, idf: np.ndarray, langs: Languages, dimensions: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of the document-term matrix: a vector for each term."""
    spark, width = table.sparkSession, dimensions + OVERSAMPLED

    def gram_times(q: np.ndarray | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf, langs, q))

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            weights, langs, q = shared.value
            if q is None:
                q = np.random.default_rng(seed).standard_normal((FEATURES, width), dtype=np.float32)
            out = np.zeros((FEATURES, width), np.float32)
            for b in batches:
                Weighted.of(b, weights, langs).add_gram(q, out)
            return out

        got = _reduce(table, ["uterms", "ucounts"], width, FEATURES, part)
        shared.destroy()
        return got

    q, _ = np.linalg.qr(gram_times(None))
    z = gram_times(q)
    b = q.T @ z
    _, vectors = np.linalg.eigh((b + b.T) / 2)
    return (q @ vectors[:, ::-1][:, :dimensions]).astype(np.float32)


def embed(table: DataFrame, idf: np.ndarray, langs: Languages, vectors: np.ndarray) -> DataFrame:
    """``doc_id lang vec``: the documents in the space of ``vectors``, of length one or zero."""
    shared = table.sparkSession.sparkContext.broadcast((idf, langs, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, langs, u = shared.value
        for b in batches:
            a = Weighted.of(b, weights, langs)
            e = _unit(a.times(u))
            vec = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), e.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a.lang), vec], names=["doc_id", "lang", "vec"])

    return table.select("doc_id", "uterms", "ucounts").mapInArrow(run, "doc_id long, lang int, vec array<float>")


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-9)


def _seeds(embedded: DataFrame, labels: DataFrame, subjects: list[str], n_langs: int) -> np.ndarray:
    """Centroids by language and subject of the labelled documents, each weighted by its labels' votes."""
    number = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    name = F.lower(F.btrim("subject"))
    votes = labels.select("doc_id", number[name].alias("s")).dropna().groupBy("doc_id", "s").count()
    every = votes.groupBy("doc_id").agg(F.sum("count").alias("n"))
    rows = embedded.join(votes.join(every, "doc_id"), "doc_id").select("lang", "vec", "s", (F.col("count") / F.col("n")).cast("float").alias("share"))
    width = len(embedded.first()["vec"]) if embedded.limit(1).count() else 1

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((n_langs * len(subjects), width), np.float32)
        for b in batches:
            if b.num_rows:
                v = b.column("vec").flatten().to_numpy().reshape(-1, width)
                at = b.column("lang").to_numpy().astype(np.int64) * len(subjects) + b.column("s").to_numpy()
                out += _sums(at, v * b.column("share").to_numpy()[:, None], len(out))
        return out

    return _reduce(rows, ["lang", "vec", "s", "share"], width, n_langs * len(subjects), part).reshape(n_langs, len(subjects), width)


def _cues(table: DataFrame, langs: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, term and beginning; of words hashed alike, the beginning that most tasks met. At most a row a language and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = langs.of(*_lists(b.column("uterms")))
            word, n = _lists(b.column("vterms"))
            cue, _ = _lists(b.column("vcues"))
            of = np.repeat(lang, n)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(langs.features(word, of)), pa.array(cue)], names=["lang", "term", "cue"])

    pairs = table.select("uterms", "vterms", "vcues").mapInArrow(run, "lang int, term long, cue int").groupBy("lang", "term", "cue").count()
    one = pairs.groupBy("lang", "term").agg(F.max(F.struct("count", "cue"))["cue"].alias("cue")).toArrow()
    return tuple(one.column(c).to_numpy().astype(np.int64) for c in ("lang", "term", "cue"))


def _carried(seeds: np.ndarray, table: DataFrame, idf: np.ndarray, langs: Languages, vectors: np.ndarray, descriptions: list[str]) -> np.ndarray:
    """``seeds`` with centroids for the pairs of language and subject that have no label.

    A beginning speaks for a subject as far as its terms are nearer to the subject's centroids than to all
    others, in the languages that have both. The terms of the language that begin so add up to the centroid,
    less what the language's labelled subjects already hold. A pair stays at zero if no term begins so.
    """
    n_langs, n, _ = seeds.shape
    labelled = np.linalg.norm(seeds, axis=-1) > 0
    if labelled.all() or seeds.shape[2] != vectors.shape[1]:  # nothing to do, or no documents
        return seeds
    lang, term, cue = _cues(table, langs)
    unit, known = _unit(vectors[term]), _unit(seeds)
    some = idf[term] > 0
    lead = np.zeros((FEATURES, n), np.float32)
    for at in range(n_langs):
        of = (lang == at) & some
        near = unit[of] @ known[at].T
        near[:, ~labelled[at]] = -1
        order = np.sort(near, axis=1)
        ahead = np.where(near == order[:, -1:], near - np.maximum(order[:, -2:-1], 0) if n > 1 else near, 0)
        np.maximum.at(lead, cue[of], ahead.astype(np.float32))
    lead[(lead < LEAD) | (lead < lead.max(axis=1, keepdims=True))] = 0
    for s in np.flatnonzero(~labelled.any(axis=0)):
        for word in set(next(iter(latex.sentences(descriptions[s] + ".")), [])):
            if (c := _cue(word)) is not None:
                lead[c, s] = 1
    seeds = seeds.copy()
    for at, s in np.argwhere(~labelled):
        of = (lang == at) & some
        got = (lead[cue[of], s] * idf[term[of]]) @ unit[of]
        claimed, _ = np.linalg.qr(known[at][labelled[at]].T)
        seeds[at, s] = got - claimed @ (claimed.T @ got)
    return seeds


def _nearest(vec: np.ndarray, lang: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosine similarities of documents to the centroids of their language."""
    return np.einsum("dk,dsk->ds", vec, centroids[lang])


def _refined(embedded: DataFrame, centroids: np.ndarray, rounds: int, least: float = 0.3) -> np.ndarray:
    """Move every centroid to the mean of the documents nearest to it, ``rounds`` times."""
    n_langs, n, width = centroids.shape
    centroids = _unit(centroids)
    for _ in range(rounds):
        shared = embedded.sparkSession.sparkContext.broadcast(centroids)

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((n_langs * n, width), np.float32)
            for b in batches:
                if b.num_rows:
                    v, lang = b.column("vec").flatten().to_numpy().reshape(-1, width), b.column("lang").to_numpy()
                    near = _nearest(v, lang, shared.value)
                    best, sure = near.argmax(axis=1), near.max(axis=1) > least
                    out += _sums((lang.astype(np.int64) * n + best)[sure], v[sure], len(out))
            return out

        new = _reduce(embedded, ["lang", "vec"], width, n_langs * n, part).reshape(centroids.shape)
        some = np.linalg.norm(new, axis=-1, keepdims=True) > 0
        centroids = np.where(some, _unit(new), centroids).astype(np.float32)
    return centroids


@dataclass
class Model:
    """What assigns sentences: languages, each term's weight and vector, and the centroids by language and subject."""

    subjects: list[str]
    langs: Languages
    mass: np.ndarray
    vectors: np.ndarray
    centroids: np.ndarray


def _shares(vec: np.ndarray, lang: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The documents' shares of subjects, from their similarities; nothing for documents without terms."""
    near = _nearest(vec, lang, centroids)
    p = np.exp(16 * (near - near.max(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    p[np.abs(near).max(axis=1) == 0] = 0
    return p.astype(np.float32)


def _term_weights(spread: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights of terms from how often documents of each of ``n`` subjects use them.

    ``spread`` has a row for each term and then one for each language, with the sum of its documents' shares;
    the last columns tell the term's language. A term's weight is its inverse document frequency times the
    divergence of its spread from its language's average, as a share of the largest it could have.
    """
    prior = spread[FEATURES:, :n]
    prior = prior / np.maximum(prior.sum(axis=1, keepdims=True), 1e-9)
    own = prior[spread[:FEATURES, n:].argmax(axis=1)]
    m = spread[:FEATURES, :n] + SMOOTH * own
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)
    divergence = (p * np.log((p + 1e-9) / (own + 1e-9))).sum(axis=1)
    largest = -np.log(np.take_along_axis(own, (p - own).argmax(axis=1)[:, None], 1)[:, 0] + 1e-9)
    return (idf * (divergence / np.maximum(largest, 0.05)).clip(0, 1)).astype(np.float32)


def _spread_of(doc_shares: np.ndarray, a: Weighted, n_langs: int) -> np.ndarray:
    """A batch's contribution to what :func:`_term_weights` reads."""
    rows = np.concatenate((doc_shares, np.eye(n_langs, dtype=np.float32)[a.lang]), axis=1)
    out = np.zeros((FEATURES + n_langs, rows.shape[1]), np.float32)
    out[:FEATURES] = _sums(a.term, rows[a.doc], FEATURES)
    out[FEATURES:] = _sums(a.lang, rows, n_langs)
    return out


def _sentence_counts(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    """How many sentences of each document treat each subject: those nearest by cosine to its centroid."""
    k = len(model.subjects)
    lang = model.langs.of(*_lists(batch.column("uterms")))
    words, _ = _lists(batch.column("terms"))
    lens, n = _lists(batch.column("lens"))
    doc = np.repeat(np.arange(len(n)), n)
    sentence = np.repeat(np.arange(len(lens)), lens)
    term = model.langs.features(words, lang[doc[sentence]])
    w = model.mass[term]
    treats = np.bincount(sentence, w, minlength=len(lens)) > LEAST_WEIGHT
    keep = (w > 0) & treats[sentence]
    at = np.cumsum(treats) - 1
    parts = np.bincount(at[sentence[keep]], minlength=int(treats.sum()))
    vec = _unit(_by_parts(model.vectors[term[keep]] * w[keep, None], parts))
    doc = doc[treats]
    best = _nearest(vec, lang[doc], model.centroids).argmax(axis=1)
    return np.bincount(doc * k + best, minlength=len(n) * k).reshape(len(n), k)


def fit(table: DataFrame, labels: DataFrame, subjects: list[str], dimensions: int = DIMENSIONS, descriptions: list[str] | None = None) -> Model:
    """Fit embedding, centroids and term weights on all documents of ``table`` (see :func:`document_terms`)."""
    spark = table.sparkSession
    langs = languages(table)
    idf = _idf(table, langs)
    vectors = _svd(table, idf, langs, dimensions)
    embedded = materialize(embed(table, idf, langs, vectors))
    n, n_langs = len(subjects), len(langs.names)
    seeds = _carried(_seeds(embedded, labels, subjects, n_langs), table, idf, langs, vectors, descriptions or [""] * n)
    centroids = _refined(embedded, seeds, ROUNDS)
    shared = spark.sparkContext.broadcast((idf, langs, vectors, centroids))

    def by_cosine(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        idf, langs, vectors, centroids = shared.value
        out = np.zeros((FEATURES + n_langs, n + n_langs), np.float32)
        for b in batches:
            a = Weighted.of(b, idf, langs)
            out += _spread_of(_shares(_unit(a.times(vectors)), a.lang, centroids), a, n_langs)
        return out

    mass = _term_weights(_reduce(table, ["uterms", "ucounts"], n + n_langs, FEATURES + n_langs, by_cosine), idf, n)
    discard(embedded)
    return Model(subjects, langs, mass, vectors, centroids)


def subject_names(subjects: DataFrame) -> dict[str, str]:
    """The areas to tell apart and their descriptions: a fixed table of a few rows, in alphabetical order."""
    name = F.lower(F.btrim("subject")).alias("subject")
    one = subjects.select(name, "description").filter("subject <> ''").groupBy("subject").agg(F.concat_ws(" ", F.sort_array(F.collect_set("description"))).alias("text"))
    rows = one.orderBy("subject").limit(MOST_SUBJECTS + 1).collect()
    if len(rows) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return {r["subject"]: r["text"] for r in rows}


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id subject n_sentences n_treated words``: the areas of each document.

    An area is treated by at least a quarter of the visible sentences that treat any; ``n_sentences`` treat it,
    of ``n_treated``, and ``words`` are the document's visible words. Comments, definitions, bibliography,
    titles and maths aren't visible, own macros stand for their definition. Null, empty and purely technical
    texts have no row. Labels may be wrong, contradictory, repeated or of unknown documents and subjects; a
    subject without any label in a language is found there by terms akin to those of its labels in other
    languages, or to its description, if the language has any. No subjects: no rows.
    """
    described = subject_names(subjects)
    names = list(described)
    schema = "doc_id long, subject string, n_sentences int, n_treated int, words long"
    if not names:
        return docs.sparkSession.createDataFrame([], schema)
    table = materialize(document_terms(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, names, descriptions=list(described.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.subjects, object)
        for b in batches:
            counts = _sentence_counts(b, model)
            total = counts.sum(axis=1)
            doc, area = np.nonzero((counts > 0) & (counts * QUARTER >= total[:, None]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(doc)), pa.array(names[area], pa.string()), pa.array(counts[doc, area].astype(np.int32)),
                    pa.array(total[doc].astype(np.int32)), b.column("words").take(pa.array(doc)),
                ],
                names=["doc_id", "subject", "n_sentences", "n_treated", "words"],
            )

    return table.select("doc_id", "words", "uterms", "terms", "lens").mapInArrow(run, schema)


def composition(found: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``subject n_docs doc_share word_share``: the corpus by area; a document of several areas counts in parts by its sentences."""
    held = found.withColumn("part", F.col("n_sentences") / F.col("n_treated"))
    by_doc = held.groupBy("doc_id").agg(F.sum("part").alias("whole"))
    parts = held.join(by_doc, "doc_id").withColumn("part", F.col("part") / F.col("whole"))
    sums = parts.groupBy("subject").agg(
        F.count("*").alias("n_docs"), F.sum("part").alias("docs"), F.sum(F.col("part") * F.col("words")).alias("words")
    )
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))  # a row a subject
    return sums.select(
        "subject", "n_docs", (F.col("docs") / F.sum("docs").over(every)).alias("doc_share"),
        (F.col("words") / F.sum("words").over(every)).alias("word_share"),
    )
