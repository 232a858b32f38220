"""Embeddings through a pluggable batch function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 10
#: Words of which a worker of the test embedder keeps the places.
KNOWN_WORDS = 1 << 14


def hashing_embedder(width: int = 64) -> Callable:
    """A deterministic embedder for tests: signed hashed words (32 bits of MD5), unit length."""

    def make():
        import functools
        import hashlib

        @functools.lru_cache(KNOWN_WORDS)
        def place(word: str) -> int:
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:4])
            return h % width + (0 if h & (1 << 31) else width)

        def embed(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for k, text in enumerate(texts):
                n = np.bincount(np.fromiter(map(place, str(text).lower().split()), np.int64), minlength=2 * width)
                out[k] = n[:width] - n[width:]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return embed

    return make


@dataclass(frozen=True)
class Model:
    """An embedder by its name and width, which a chunk table is stamped with. `make` returns a function
    of a batch of texts and is called once per worker."""

    name: str
    width: int
    make: Callable

    def embed(self, df: DataFrame, text: str = "content", batch: int = BATCH, partitions: int | None = None) -> DataFrame:
        return embed(df, self.make, self.width, text, batch, partitions)


def hashing_model(width: int = 64) -> Model:
    return Model(f"hashing-{width}", width, hashing_embedder(width))


def embed(df: DataFrame, make_embedder: Callable, width: int, text: str = "content", batch: int = BATCH, partitions: int | None = None) -> DataFrame:
    """`df` with `vector` of each text. The embedder is made once per worker; `partitions` spreads its
    work; equal texts are embedded once. Texts are shuffled by their hash, and then each distinct one once
    more, with its vector, to the other columns, which travel without texts. Null texts are embedded
    as empty ones and stay null. `df` is read twice: save it first if it is dear.
    """
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = df.groupBy(key.alias("__sha")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    if partitions:
        texts = texts.repartition(partitions, "__sha")
    udf = predict_batch_udf(make_embedder, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    vectors = texts.select("__sha", "__text", udf("__text").alias("vector"))
    checked = F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {width} numbers, not "), F.size("vector"))))
    kept = [c for c in df.columns if c not in ("vector", text)]
    rows = df.select(*kept, key.alias("__sha"), F.col(text).isNull().alias("__none")).join(vectors, "__sha")
    again = [F.when(~F.col("__none"), F.col("__text")).alias(c) if c == text else F.col(c) for c in df.columns if c != "vector"]
    return rows.select(*again, checked.alias("vector"))


def paired(df: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """`df` with precomputed vectors (key, vector)."""
    return df.join(vectors.select(key, "vector"), key)
