"""Vector columns and the embedders."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


class Embedder(ABC):
    """Turns texts into vectors; `column` makes an Arrow-batched function of it."""

    dimension: int

    @abstractmethod
    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]

    def column(self):
        me = self

        def run(texts: pd.Series) -> pd.Series:
            m = me.embed_documents([t or "" for t in texts])
            n = np.linalg.norm(m, axis=1, keepdims=True)
            return pd.Series(list((m / np.where(n > 0, n, 1)).astype("float32")))

        return F.pandas_udf(run, "array<float>")


class HashingEmbedder(Embedder):
    """Signed hashing of words; needs no model and always gives the same vectors."""

    def __init__(self, dimension: int = 64, prefix: str = ""):
        self.dimension, self.prefix = dimension, prefix

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        m = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                m[i, h % self.dimension] += 1 if h >> 16 & 1 else -1
        return m

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([self.prefix + text])[0]
