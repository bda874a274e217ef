"""Has this key been seen before? Stored partitions of minimal perfect hashes with fingerprints.

Keys are hashed over a fixed number of partitions. When a batch is over, each partition's keys are sealed: a
minimal perfect hash and a fingerprint for each slot, stored as one row of a table and never changed again. A
new batch is decided by an exact set of its own keys and by the fingerprints of the sealed rows of its
partitions; earlier keys are neither read nor kept. What fingerprints claim can then be checked exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import norm_id
from ..workspace import discard, materialize, sized_broadcast

#: Batches into which a whole log is cut, alike in rows, to be walked as if it arrived so.
BATCHES = 8
#: Rows of a log that one key partition has in all; of its 24 bytes each, a task holds those of one batch.
ROWS_A_PARTITION = 4_000_000
#: Bits of a key's fingerprint. A lookup of a new key in one sealed partition is wrong in one of 2^BITS cases.
BITS = 16
#: Bits of a level's array for each key still without a slot.
SPREAD = 2.0
#: Repeats within one Arrow block from which a task remembers a key, and how many keys it remembers so.
HOT, REMEMBERED = 64, 100_000

STORED = "part int, batch int, n_keys long, body binary"
_WALKED = "put_seq long, h1 long, again boolean, hits int, lookups int, " + STORED


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A further hash of 64-bit hashes: two rounds of multiply and shift."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sealed:
    """Minimal perfect hash of a set of 64-bit hashes plus a fingerprint in each slot; the keys aren't kept.

    Level by level, every key without a slot sets a bit of an array; bits that just one key sets are slots,
    numbered by their rank, and the other keys go on to the next level. The fingerprint is taken from a
    second, independent hash; the few keys that share a first hash with another are kept whole.
    """

    def __init__(self, h: np.ndarray, second: np.ndarray, bits: int = BITS) -> None:
        self.bits = bits
        _, one = np.unique(h, return_index=True)
        rest = np.ones(len(h), bool)
        rest[one] = False
        self._whole(h[rest], second[rest])
        h, second = h[one], second[one]
        words, left = [], h
        while len(left):
            m = max(64, int(len(left) * SPREAD) + 63 & ~63)
            at = (_mix(left, len(words)) % np.uint64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            words.append(np.packbits(once, bitorder="little").view(np.uint64))
            left = left[~once[at]]
        self._ranked(words)
        self.prints = np.zeros(self.size, self._kind())
        self.prints[self.slots(h)] = self._print(second)

    def _whole(self, h: np.ndarray, second: np.ndarray) -> None:
        self.shared = np.stack((h, second)) if len(h) else np.zeros((2, 0), np.uint64)
        self.whole = set(zip(self.shared[0].tolist(), self.shared[1].tolist()))

    def _ranked(self, words: list[np.ndarray]) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.levels.append((64 * len(w), w, self.size + np.cumsum(ones) - ones))
            self.size += int(ones.sum())

    def _kind(self) -> type:
        return np.uint32 if self.bits > 16 else np.uint16

    def _print(self, second: np.ndarray) -> np.ndarray:
        return (second & np.uint64((1 << self.bits) - 1)).astype(self._kind())

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those that certainly aren't in the set."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, (m, words, rank) in enumerate(self.levels):
            if not len(todo):
                break
            at = (_mix(h[todo], k) % np.uint64(m)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = rank[at[hit] >> 6] + np.bitwise_count(below[hit])
            todo = todo[~hit]
        return out

    def seen(self, h: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the set may hold each key: always true for those it holds, true by chance in 2^-bits of the others."""
        slot = self.slots(h)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == self._print(second[found])
        if self.whole:
            found |= np.fromiter((k in self.whole for k in zip(h.tolist(), second.tolist())), bool, len(h))
        return found

    def dump(self) -> bytes:
        """What is stored: bits, the levels' arrays, fingerprints, and keys kept whole."""
        lengths = [len(w) for _, w, _ in self.levels]
        head = struct.pack(f"<4I{len(lengths)}I", self.bits, len(lengths), self.size, self.shared.shape[1], *lengths)
        return head + b"".join([w.tobytes() for _, w, _ in self.levels]) + self.prints.tobytes() + self.shared.tobytes()

    @classmethod
    def load(cls, body: bytes) -> Sealed:
        """The set that :meth:`dump` wrote."""
        self = cls.__new__(cls)
        self.bits, n, size, shared = struct.unpack_from("<4I", body)
        lengths, at, words = struct.unpack_from(f"<{n}I", body, 16), 16 + 4 * n, []
        for length in lengths:
            words.append(np.frombuffer(body[at : at + 8 * length], np.uint64))
            at += 8 * length
        self._ranked(words)
        width = np.dtype(self._kind()).itemsize
        self.prints = np.frombuffer(body[at : at + width * size], self._kind())
        pairs = np.frombuffer(body[at + width * size :], np.uint64).reshape(2, shared)
        self._whole(pairs[0], pairs[1])
        return self


# -- keys ---------------------------------------------------------------------------------------------


def hashed(puts: DataFrame, base: DataFrame | None, batch: Column, parts: int) -> DataFrame:
    """``put_seq batch part h1 h2`` of every row with an id; ``base`` is stored before everything, in batch -1."""
    rows = puts.select("put_seq", norm_id("id").alias("id"), batch.cast("int").alias("batch"))
    if base is not None:
        rows = rows.unionByName(base.select(F.lit(-1).cast("long").alias("put_seq"), norm_id("id").alias("id"), F.lit(-1).alias("batch")))
    h = rows.filter("id is not null").withColumns({"h1": F.xxhash64("id"), "h2": F.xxhash64(F.lit(7), "id")})
    return h.select("put_seq", "batch", F.pmod("h1", F.lit(parts)).cast("int").alias("part"), "h1", "h2")


def key_parts(puts: DataFrame) -> int:
    """Key partitions for a log: by its counted rows, and at least as many as shuffles have."""
    return max(int(puts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-puts.count() // ROWS_A_PARTITION))


def batches_of(puts: DataFrame, batches: int = BATCHES) -> Column:
    """The batch of a put: between approximate quantiles of the numbers, so batches have alike many rows whatever the numbers."""
    if batches < 2:
        return F.lit(0)
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    edges = puts.agg(F.percentile_approx("put_seq", shares, 10_000).alias("q")).first()["q"] or []
    out = F.lit(0)
    for q in edges:
        out = out + (F.col("put_seq") > q).cast("int")
    return out


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark rows whose key the task has met in the same batch with a smaller number: they repeat it whatever else there is.

    A key of any share of the rows so leaves a row or a few a task.
    """
    met: dict[tuple[int, int, int], int] = {}
    for t in batches:
        t = t.iloc[np.lexsort((t["put_seq"], t["batch"], t["h2"], t["h1"]))]
        a = t[["h1", "h2", "batch"]].to_numpy()
        first = np.ones(len(t), bool)
        first[1:] = (a[1:] != a[:-1]).any(axis=1)
        again, starts = ~first, np.flatnonzero(first)
        number = t["put_seq"].to_numpy()
        for i in starts[np.diff(np.r_[starts, len(t)]) >= HOT] if not met else starts:
            key = tuple(a[i])
            if key in met and met[key] < number[i]:
                again[i] = True
            elif key in met or len(met) < REMEMBERED:
                met[key] = number[i]
        yield t.assign(again=again)


def _decide(t: pd.DataFrame, sealed: list[Sealed]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """One batch's rows of one partition, and its distinct keys."""
    t = t.iloc[np.lexsort((t["put_seq"], t["h2"], t["h1"]))]
    h1, h2 = t["h1"].to_numpy(), t["h2"].to_numpy()
    again = np.zeros(len(t), bool)
    again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    a, b = h1[~again].view(np.uint64), h2[~again].view(np.uint64)
    hits = np.zeros(len(t), np.int32)
    for s in sealed:
        hits[~again] += s.seen(a, b)
    out = pd.DataFrame({"put_seq": t["put_seq"].to_numpy(), "h1": h1, "again": again, "hits": hits, "lookups": np.where(again, 0, len(sealed))})
    return out, a, b


def _walk(bits: int, keep: bool):
    """Walk each partition's rows batch by batch against the sealed ones before; memory holds one batch of keys."""
    none = {"part": None, "batch": None, "n_keys": None, "body": None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sealed: list[Sealed] = []
        held: list[pd.DataFrame] = []
        at = None

        def over() -> Iterator[pd.DataFrame]:
            part, batch = at
            rows, a, b = _decide(pd.concat(held), sealed)
            sealed.append(Sealed(a, b, bits))
            if batch >= 0:  # batch -1 holds what was stored before everything
                yield rows.assign(**none)
            if keep:
                yield pd.DataFrame([{"put_seq": None, "h1": None, "again": None, "hits": None, "lookups": None, "part": part, "batch": batch, "n_keys": len(a), "body": sealed[-1].dump()}])

        for t in batches:
            passed = t["again"].to_numpy()
            if passed.any():
                yield t.loc[passed, ["put_seq", "h1", "again"]].assign(hits=0, lookups=0, **none)
                t = t[~passed]
            for (part, batch), rows in t.groupby(["part", "batch"], sort=True):
                if at is not None and at != (part, batch):
                    yield from over()
                    held.clear()
                    if at[0] != part:
                        sealed.clear()
                at = (part, batch)
                held.append(rows)
        if held:
            yield from over()

    return run


def walk(rows: DataFrame, parts: int, bits: int = BITS, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Decide a log of several batches and seal them, with one shuffle: (answers, sealed partitions).

    ``rows`` are :func:`hashed`. Answers: ``put_seq h1 again hits lookups``. ``again``: the key occurred before in
    the put's own batch (exact). ``hits``: how many sealed partitions of earlier batches have the key's
    fingerprint in its slot; ``lookups``: how many were asked. ``keep`` also stores what was sealed.
    """
    marked = rows.mapInPandas(_repeated, "put_seq long, batch int, part int, h1 long, h2 long, again boolean")
    # repeats go anywhere, so a key of any share of the rows stays spread
    where = F.when(F.col("again"), F.xxhash64("put_seq")).otherwise(F.xxhash64("part"))
    out = materialize(marked.repartition(parts, where).sortWithinPartitions("part", "batch").mapInPandas(_walk(bits, keep), _WALKED))
    return out.filter("put_seq is not null").drop("part", "batch", "n_keys", "body"), out.filter("body is not null").select("part", "batch", "n_keys", "body")


def seal(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The sealed partitions of :func:`hashed` rows: one row for each key partition and batch, to be appended to a stored table."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        s = Sealed(t["h1"].to_numpy().view(np.uint64), t["h2"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame([{"part": t["part"].iat[0], "batch": t["batch"].iat[0], "n_keys": len(t), "body": s.dump()}])

    keys = rows.groupBy("part", "batch", "h1", "h2").agg(F.lit(1).alias("one")).drop("one")
    return keys.groupBy("part", "batch").applyInPandas(one, STORED)


def lookup(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Decide one new batch by the stored partitions alone: ``put_seq h1 again hits lookups`` as :func:`walk` has them.

    Of the stored table only the batch's own key partitions meet its rows; a task holds one partition of it.
    """

    def one(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        passed = t["again"].to_numpy(bool)
        done = t.loc[passed, ["put_seq", "h1", "again"]].assign(hits=0, lookups=0)
        return pd.concat([done, _decide(t[~passed], [Sealed.load(b) for b in s["body"]])[0]])

    # the first repeats of hot keys are found before the shuffle and go to partitions of their own
    marked = rows.mapInPandas(_repeated, "put_seq long, batch int, part int, h1 long, h2 long, again boolean")
    spread = marked.withColumn("part", F.when(F.col("again"), -1 - F.pmod("put_seq", F.lit(4096))).otherwise(F.col("part")).cast("int"))
    return spread.groupBy("part").cogroup(stored.groupBy("part")).applyInPandas(one, "put_seq long, h1 long, again boolean, hits int, lookups int")


# -- exact answers and their measure -----------------------------------------------------------------------


def claims_checked(puts: DataFrame, base: DataFrame, looked: DataFrame) -> DataFrame:
    """``put_seq right``: the claims of the fingerprints, and whether an earlier put or ``base`` really has the id.

    Only rows of claimed hashes take part: the claims' hashes, broadcast within a counted bound and joined by a
    shuffle beyond, filter the log before anything is grouped.
    """
    claims = materialize(looked.filter("not again and hits > 0").select("put_seq", "h1"))
    wanted = materialize(claims.select("h1").distinct())
    rows = puts.select("put_seq", norm_id("id").alias("id")).unionByName(base.select(F.lit(-1 << 62).alias("put_seq"), norm_id("id").alias("id")))
    rows = rows.filter("id is not null").withColumn("h1", F.xxhash64("id"))
    near = materialize(rows.join(sized_broadcast(wanted, wanted.count()), "h1", "left_semi").select("put_seq", "id"))
    first = near.groupBy("id").agg(F.min("put_seq").alias("first_seq"))
    discard(wanted)
    return near.join(claims.select("put_seq"), "put_seq").join(first, "id").select("put_seq", (F.col("first_seq") < F.col("put_seq")).alias("right"))


def _exact(looked: DataFrame, checked: DataFrame) -> DataFrame:
    return looked.filter("again").select("put_seq").unionByName(checked.filter("right").select("put_seq"))


def seen_before(puts: DataFrame, base: DataFrame, batches: int = BATCHES, bits: int = BITS) -> DataFrame:
    """``put_seq``: the puts whose id is in ``base`` or in a put of smaller number.

    The log is walked in ``batches`` against its sealed partitions (:func:`walk`); what fingerprints alone claim
    is checked exactly, and as a sealed partition never misses a key it holds, the result is exact. Null ids (and
    the NULL id) are never seen; an empty ``base`` or ``puts`` gives what the definition says. Of rows with one
    number and id in one batch, one counts as the first; numbers are unique in the intended tables.
    """
    parts = key_parts(puts)
    looked, _ = walk(hashed(puts, base, batches_of(puts, batches), parts), parts, bits, keep=False)
    return _exact(looked, claims_checked(puts, base, looked))


def seen_in_new_batch(earlier: DataFrame, new: DataFrame, base: DataFrame, bits: int = BITS) -> DataFrame:
    """``put_seq``: the puts of ``new`` whose id is in ``base``, in ``earlier`` or in a put of ``new`` with smaller number.

    ``earlier`` has a column ``batch``. Its batches are sealed into a stored table; the new batch is decided by
    that table and its own exact set, and only the ids it claims are then looked up among the earlier ones.
    """
    parts = key_parts(earlier)
    stored = materialize(seal(hashed(earlier, base, F.col("batch"), parts), bits))
    looked = materialize(lookup(hashed(new, None, F.lit(1 << 30), parts), stored))
    puts = earlier.select("put_seq", "id").unionByName(new.select("put_seq", "id"))
    return _exact(looked, claims_checked(puts, base, looked))


def wrong_answers(puts: DataFrame, base: DataFrame, batches: int = BATCHES, bits: int = BITS) -> DataFrame:
    """One row: puts with an id, answers by fingerprint, lookups, wrong answers, their share, and the expected share.

    An answer is wrong if fingerprints claim an id that no earlier put or ``base`` has. ``expected_rate``
    is what ``lookups`` of new ids against fingerprints of ``bits`` bits would give. ``bytes_a_key`` is the size
    of the sealed partitions for each key they hold.
    """
    parts = key_parts(puts)
    looked, stored = walk(hashed(puts, base, batches_of(puts, batches), parts), parts, bits)
    checked = claims_checked(puts, base, looked)
    wrong = checked.agg(F.count(F.when(~F.col("right"), 1)).alias("wrong_answers"), F.count("*").alias("claims"))
    total = looked.agg(
        F.count("*").alias("puts"), F.count(F.when(F.col("again"), 1)).alias("repeats_in_batch"),
        F.coalesce(F.sum(F.when(F.col("hits") == 0, F.col("lookups"))), F.lit(0)).alias("lookups_of_new"),
    )
    held = stored.agg(F.sum("n_keys").alias("sealed_keys"), F.sum(F.length("body")).alias("size"))
    rate = lambda a: F.when(F.col("puts") > 0, a / F.col("puts")).otherwise(F.lit(0.0))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(total).join(one(wrong), "k").join(one(held), "k").select(
        "puts", "repeats_in_batch", "claims", "wrong_answers", rate(F.col("wrong_answers")).alias("wrong_rate"),
        rate(F.col("lookups_of_new") / F.lit(float(1 << bits))).alias("expected_rate"), F.coalesce("sealed_keys", F.lit(0)).alias("sealed_keys"),
        F.when(F.col("sealed_keys") > 0, F.col("size") / F.col("sealed_keys")).alias("bytes_a_key"),
    )
