"""Embedding of chunks: a pluggable embedder behind a cache by content hash."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import cache_misses


#: Words whose part is remembered by a worker.
KNOWN = 50_000


class Embedder(Protocol):
    size: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedNgrams:
    """Default embedder: signed hashed counts of words and character trigrams, unit length. Lexical, not semantic."""

    def __init__(self, size: int = 64):
        self.size = size
        self.known: dict[str, np.ndarray] = {}  # words seen before

    def word(self, word: str) -> np.ndarray:
        """What one occurrence of a word adds."""
        out, padded = np.zeros(self.size, np.float32), f" {word} "
        for gram in (word, *(padded[i : i + 3] for i in range(len(padded) - 2))):
            h = zlib.crc32(gram.encode())
            out[h % self.size] += 1 if h >> 31 else -1
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(re.findall(r"[^\W_]+", text.lower())).items():
                if word not in self.known:
                    if len(self.known) >= KNOWN:
                        self.known.clear()
                    self.known[word] = self.word(word)
                row += n * self.known[word]
            size = float(np.linalg.norm(row))
            if size:
                row /= size
        return out


def embed_chunks(chunks: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """(content_hash, vector) for the chunks' contents that the cache has not, each once."""
    missing = cache_misses(chunks, cache)

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embedder(list(part))))

    return missing.select("content_hash", embed("content").alias("vector"))
