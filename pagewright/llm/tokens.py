"""Byte-level BPE tokens from a public vocabulary file.

The file (base64 ranks, one a line) is read once on the driver and broadcast; its size is that of the vocabulary. Tokens
tile a text's UTF-8 bytes, so offsets are sums of token sizes and decoding gives the bytes back. Bytes that are no UTF-8
count as replacement characters.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern of pieces that are never merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Encodes and decodes. ``special`` strings get ids beyond the vocabulary's; only ``encode_marked`` knows them."""

    def __init__(self, data: bytes, special: Sequence[str] = ()):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        first = max(ranks.values()) + 2  # the next id is the end-of-text mark's
        self.special = {name: first + k for k, name in enumerate(special)}
        self.encoding = tiktoken.Encoding("pagewright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = {rank: token for token, rank in ranks.items()} | {k: name.encode() for name, k in self.special.items()}
        self.sizes = np.zeros(first + len(self.special), np.int64)
        for k, token in self.bytes_of.items():
            self.sizes[k] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """Token ids; special strings are ordinary text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if not self.special else np.array(self.encoding.encode_ordinary(text), np.int32)

    def encode_marked(self, text: str) -> np.ndarray:
        """Token ids, with the special strings as tokens of their own."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.sizes[ids])

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(4)
def _vocabulary(data: bytes, special: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(data, special)


def load(path: str = VOCABULARY, special: Sequence[str] = ()) -> Vocabulary:
    with open(path, "rb") as f:
        return _vocabulary(f.read(), tuple(special))


def shipped(spark: SparkSession, path: str = VOCABULARY, special: Sequence[str] = ()) -> Callable[[], Vocabulary]:
    """A function that gives tasks the vocabulary; a worker builds it once."""
    with open(path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    names = tuple(special)
    return lambda: _vocabulary(data.value, names)


def token_count(spark: SparkSession, text: str | Column, path: str = VOCABULARY) -> Column:
    """How many tokens a text has; null has none."""
    get = shipped(spark, path)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = get()
        for part in texts:
            yield pd.Series([len(v.encode(x.decode("utf-8", "replace"))) for x in part], dtype="int64")

    return count(utf8(text))


def token_prefix(spark: SparkSession, text: str | Column, n: str | Column, path: str = VOCABULARY) -> Column:
    """The text of the first ``n`` tokens, up to its last whole character."""
    get = shipped(spark, path)

    @F.pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        v = get()
        for texts, sizes in parts:
            yield pd.Series([v.decode(v.encode(x.decode("utf-8", "replace"))[:k].tolist()).decode("utf-8", "ignore") for x, k in zip(texts, sizes, strict=True)], dtype=object)

    return cut(utf8(text), n)
