"""Keeping vectors in step with passages: what is pending, embedding in batches, writing only what is still current."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dimensions: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed hashes of a text's words, at length 1 (0 for no words)."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return embed


def pending(chunks: DataFrame, vectors: DataFrame, space: str, key: str = "chunk_id") -> DataFrame:
    """Chunks without a vector in a space, each once."""
    return chunks.dropDuplicates([key]).join(vectors.filter((F.col("space_id") == space) & F.col("vector").isNotNull()).select(key), key, "left_anti")


def embedded(chunks: DataFrame, embed: Embedder, space: str, key: str = "chunk_id", text: str = "chunk_text", batch: int = 16) -> DataFrame:
    """(key, space_id, vector, content_hash): the chunks' vectors, with the revision that was read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["__text"].tolist()
            vs = [v for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])]
            yield pd.DataFrame({key: pdf[key], "space_id": space, "vector": pd.Series(vs, dtype=object), "content_hash": pdf["content_hash"]}).astype({"space_id": object})

    rows = chunks.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"), "content_hash")
    return rows.mapInPandas(run, f"{key} bigint, space_id string, vector array<float>, content_hash string")


def still_current(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors whose chunk still has the revision that was embedded; the others are to be read again."""
    return vectors.join(chunks.select(key, "content_hash").distinct(), [key, "content_hash"], "left_semi")


def admitted(eligible: DataFrame, known: DataFrame, scope: str, key: str, revision: str) -> DataFrame:
    """(scope, key, revision, seq): eligible revisions with their number; new ones are numbered on in the order of key, outdated ones are gone."""
    kept = known.join(eligible.select(scope, key, revision).distinct(), [scope, key, revision], "left_semi").select(scope, key, revision, "seq")
    last = known.groupBy(scope).agg(F.max("seq").alias("__last"))
    new = eligible.select(scope, key, revision).distinct().join(kept, [scope, key, revision], "left_anti").join(last, scope, "left")
    return kept.unionByName(new.select(scope, key, revision, (F.coalesce("__last", F.lit(0)) + F.expr(f"row_number() OVER (PARTITION BY {scope} ORDER BY {key})")).cast("bigint").alias("seq")))
