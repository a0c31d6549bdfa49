"""The slot for a text embedder, and a deterministic one that needs no model.

An embedder turns a list of texts into vectors of one length; it is given to the engine, may be absent,
and is only asked about texts whose language suits it. If it fails on a batch, those texts have no
vector. Null and blank texts have none either.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.derive import suits_model

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed counts of hashed words and their trigrams, of length 1: texts that share words are similar."""
    from recordloom.operators.rank import grams_of, stems_of

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for s in stems_of(t):
                for feature, weight in [(s, 1.0), *((g, 0.3) for g in grams_of(s))]:
                    h = zlib.crc32(feature.encode())
                    out[i, h % dim] += weight if h & 0x10000 else -weight
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def with_embedding(df: DataFrame, embedder: Embedder | None, text: str = "text", out: str = "embedding") -> DataFrame:
    """df with a column of vectors; without an embedder all are null."""
    if embedder is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    asked = F.when(suits_model(F.col(text)) & (F.trim(text) != ""), F.col(text))
    rest = [c for c in df.columns if c != out]
    schema = df.select(*rest).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            vectors: list[list[float] | None] = [None] * len(texts)
            try:
                for i, v in zip(some, embedder([texts[i] for i in some]), strict=True):
                    vectors[i] = [float(x) for x in v]
            except Exception:  # noqa: BLE001 - a failing model must not stop a save
                vectors = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=[*rest, out])

    return df.select(*rest, asked.alias("_asked")).mapInArrow(run, schema)
