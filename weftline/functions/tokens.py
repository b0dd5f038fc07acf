"""Lengths in tokens of a public byte-level BPE, read from its file of ranks; nothing is trained here.

The driver reads the file and ships it to the executors, which need not have it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on the driver; every function that counts tokens takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoder(ranks_file: bytes):
    """The encoder of a file of ranks, built once for a process."""
    key = hash(ranks_file)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def encoding(path: str = VOCABULARY):
    with open(path, "rb") as f:
        return encoder(f.read())


def _ship(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: under 1 MB, whatever the input


def count_tokens(df: DataFrame, keep: list[str], texts: Column, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the sum over ``texts``, an array of strings; nulls count nothing."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"
    shipped = _ship(df, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shipped.value).encode_ordinary
        for pdf in batches:
            n = [0 if t is None else sum(len(encode(x)) for x in t if x) for t in pdf["_texts"]]
            yield pdf[keep].assign(tokens=pd.Series(n, index=pdf.index, dtype="int64"))

    return df.select(*keep, texts.alias("_texts")).mapInPandas(run, schema)


def token_ids(df: DataFrame, keep: list[str], text: Column, path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``ids``, the text's tokens; null for null."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>"
    shipped = _ship(df, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shipped.value).encode_ordinary
        for pdf in batches:
            yield pdf[keep].assign(ids=[None if t is None else encode(t) for t in pdf["_text"]])

    return df.select(*keep, text.alias("_text")).mapInPandas(run, schema)
