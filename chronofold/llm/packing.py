"""Filling containers of fixed capacity with whole texts, by vector best-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from .tokens import with_tokens

#: Texts packed together in one task.
BLOCK = 4096
#: A container takes one document for each so many tokens of its capacity, and at least four.
TOKENS_A_DOCUMENT = 64
#: Attention cost a container takes, as a share of the square of its capacity in tokens. One text of more than
#: sqrt(0.9) = 95 % of the capacity is above it and so stays alone; shares of 1 and more never bind.
ATTENTION_SHARE = 0.9
#: Kinds of containers that may be asked for; more are an error.
MOST_KINDS = 1000
#: Weights of the residual token, document-count and attention-cost capacities.
WEIGHTS = (1.0, 0.25, 0.25)

CONTENTS = "container_kind string, container_id long, item_no int, doc_id long, token_from long, token_to long, container_tokens long, unused_tokens long"


def best_fit(sizes: np.ndarray, capacity: int, documents: int, cost: float, by: str = "norm", weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The bin of each item; ``sizes`` are positive, in descending order and at most ``capacity``.

    An item takes its tokens, one document and its squared tokens (what attention costs) of a bin's
    capacities, and may go only where all three suffice; if it goes nowhere it opens a bin, even if its
    own cost is above ``cost``. Of the bins it fits, ``norm`` takes the one with the smallest weighted norm
    of the capacities left then, ``dot`` the one with the largest weighted product of item and residual.
    Ties go to the oldest bin.
    """
    scale = np.array([capacity, documents, cost], float)
    w = np.array(weights) if by == "dot" else np.sqrt(np.array(weights))
    left = np.empty((3, max(1, len(sizes))))  # residuals as shares of the capacities, times the weights
    number, out, n, made = np.empty(max(1, len(sizes)), np.int64), np.empty(len(sizes), np.int64), 0, 0
    least = float(sizes[-1]) / capacity * w[0] if len(sizes) else 0.0
    for i, s in enumerate(sizes):
        item = np.array([s, 1.0, float(s) * s]) / scale * w
        after = left[:, :n] - item[:, None]
        fits = (after > -1e-9).all(axis=0)
        at = -1
        if fits.any():
            if by == "dot":
                score = np.where(fits, item @ left[:, :n] / 1.0, -np.inf)
                at = int(score.argmax())
            else:
                score = np.where(fits, np.einsum("ij,ij->j", after, after), np.inf)
                at = int(score.argmin())
            left[:, at] = after[:, at]
        else:
            left[:, n], number[n], at = w - item, made, n
            n, made = n + 1, made + 1
        out[i] = number[at]
        if i % 64 == 63:  # bins that can take nothing more are closed
            keep = (left[0, :n] >= least - 1e-9) & (left[1, :n] > -1e-9 + w[1] / documents)
            k = int(keep.sum())
            if k < n:
                left[:, :k], number[:k], n = left[:, :n][:, keep], number[:n][keep], k
    return out


def _pack(t: pd.DataFrame, kinds: list[tuple[str, int]], by: str, attention: float, tokens_a_document: int) -> pd.DataFrame:
    ids, tokens = t["doc_id"].to_numpy(), t["n_tokens"].to_numpy()
    order = np.lexsort((ids, -tokens))
    ids, tokens, block = ids[order], tokens[order], int(t["block"].iat[0])
    parts = []
    for kind, capacity in kinds:
        full = np.where(tokens > capacity, tokens // capacity, 0)
        rest = tokens - full * capacity
        # pieces of texts above the capacity fill containers of their own
        doc = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        whole = np.flatnonzero(rest > 0)
        whole = whole[np.argsort(-rest[whole], kind="stable")]
        bins = best_fit(rest[whole], capacity, max(4, capacity // tokens_a_document), attention * float(capacity) ** 2, by)
        at = np.concatenate((doc, whole))
        start = np.concatenate((piece * capacity, full[whole] * capacity))
        size = np.concatenate((np.full(len(doc), capacity), rest[whole]))
        box = np.concatenate((np.arange(len(doc)), bins + len(doc)))
        held = np.bincount(box, weights=size).astype(np.int64) if len(box) else np.zeros(0, np.int64)
        by_box = np.argsort(box, kind="stable")
        at, start, size, box = at[by_box], start[by_box], size[by_box], box[by_box]
        first = np.flatnonzero(np.r_[True, box[1:] != box[:-1]]) if len(box) else np.zeros(0, int)
        item = np.arange(len(box)) - np.repeat(first, np.diff(np.r_[first, len(box)]))
        parts.append(pd.DataFrame({
            "container_kind": kind, "container_id": (block << 32) + box, "item_no": item, "doc_id": ids[at],
            "token_from": start, "token_to": start + size, "container_tokens": held[box], "unused_tokens": capacity - held[box],
        }))
        none = ids[tokens == 0]
        if len(none):
            parts.append(pd.DataFrame({"container_kind": kind, "container_id": None, "item_no": 0, "doc_id": none, "token_from": 0, "token_to": 0, "container_tokens": 0, "unused_tokens": 0}))
    out = pd.concat(parts, ignore_index=True)
    return out.astype({"container_id": "Int64", "item_no": "int32"})


def pack_documents(docs: DataFrame, sizes: DataFrame, block: int = BLOCK, by: str = "norm", tokens: DataFrame | None = None, attention: float = ATTENTION_SHARE, tokens_a_document: int = TOKENS_A_DOCUMENT) -> DataFrame:
    """The contents of containers of every kind in ``sizes``, one row for each text or piece of a text.

    ``container_kind container_id item_no doc_id token_from token_to container_tokens unused_tokens``: the
    tokens ``[token_from, token_to)`` of ``doc_id`` are in that container. Each text is in one container of
    each kind; only one longer than the capacity is cut, into full containers and a rest that is packed
    like a text. A container takes ``capacity_tokens`` tokens, a document for each ``tokens_a_document`` of them (at
    least four), and an attention cost, the sum of its texts' squared tokens, of ``attention`` times the square of
    ``capacity_tokens``; only a text that alone costs more is above that, and then alone. Texts without tokens (null or empty) take no space: one row a kind with a null container.
    Repeated rows are texts of their own. Blocks of about ``block`` texts, by hash of the id, are packed
    apart, so tasks are alike at any size and at most a few containers a block stay part empty. Kinds of
    null or non-positive capacity are ignored; ``sizes`` is a fixed table of a few rows.
    """
    kinds = [
        (r["container_kind"], int(r["capacity_tokens"]))
        for r in sizes.select("container_kind", "capacity_tokens").distinct().filter("capacity_tokens > 0").orderBy("capacity_tokens", "container_kind").limit(MOST_KINDS + 1).collect()
    ]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    counted = materialize((tokens if tokens is not None else with_tokens(docs)).select("doc_id", "n_tokens"))
    blocks = max(1, -(-counted.count() // block))
    placed = counted.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    if not kinds:
        return counted.sparkSession.createDataFrame([], CONTENTS)
    # numbers of tokens are small but packing them isn't: as many tasks as blocks, not as their bytes would ask for
    spread = placed.repartition(min(blocks, 20_000), "block")
    return spread.groupBy("block").applyInPandas(lambda t: _pack(t, kinds, by, attention, tokens_a_document), CONTENTS)


def fill_report(contents: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each kind: containers, texts, texts without tokens, tokens, unused tokens, the filled share, and the most a container holds.

    ``most_documents`` is the largest number of texts in a container, ``most_attention`` the largest attention
    cost of one with several, as a share of the square of its capacity.
    """
    one = F.col("item_no") == 0
    held = F.col("container_id").isNotNull()
    size = (F.col("token_to") - F.col("token_from")).cast("double")
    boxes = contents.filter(held).groupBy("container_kind", "container_id").agg(
        F.count("*").alias("n"), (F.sum(size * size) / F.pow(F.first(F.col("container_tokens") + F.col("unused_tokens")), F.lit(2))).alias("cost")
    )
    most = boxes.groupBy("container_kind").agg(F.max("n").alias("most_documents"), F.max(F.when(F.col("n") > 1, F.col("cost"))).alias("most_attention"))
    report = (
        contents.groupBy("container_kind")
        .agg(
            F.count(F.when(one & held, 1)).alias("containers"),
            F.count(F.when(held & (F.col("token_from") == 0), 1)).alias("texts"),
            F.count(F.when(~held, 1)).alias("texts_without_tokens"),
            F.coalesce(F.sum(F.when(one, F.col("container_tokens"))), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.when(one & held, F.col("unused_tokens"))), F.lit(0)).alias("unused_tokens"),
        )
        .withColumn("filled_share", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("tokens") + F.col("unused_tokens"))))
    )
    return report.join(most, "container_kind", "left")
