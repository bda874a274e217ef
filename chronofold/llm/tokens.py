"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files, and the one used unless told otherwise.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Where byte-level BPE splits a text before merging. Fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_tokens(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id source n_tokens`` of every row of ``docs``; null and empty texts have 0 tokens.

    Texts are tokenized whole. The vocabulary file, of fixed size, is sent to the executors once.
    ``source`` is trimmed and in lower case; where ``docs`` has none it is null.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for t in batches:
            yield pd.DataFrame({"doc_id": t["doc_id"], "source": t["source"], "n_tokens": [len(encode(x)) if x else 0 for x in t["text"]]})

    source = norm_source(F.col("source")) if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", source.alias("source"), "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def norm_source(c: Column) -> Column:
    """Name of a source: letter case and surrounding blanks don't count, a blank name is none."""
    x = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(x != "", x)
