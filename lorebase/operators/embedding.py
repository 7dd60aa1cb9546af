"""Embedding refresh: find pending rows, embed them in batches, write back."""

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorebase.sources.scratch import kept

# Fixed values of the source.
BATCH = 50
DIMENSIONS = 1536
DECIMALS = 8

Embedder = Callable[[Sequence[str]], np.ndarray]


def is_pending():
    return F.col("embedding").isNull() | F.coalesce("embedding_stale", F.lit(False))


def pending(df: DataFrame, text: str, tenant: str | None = None) -> DataFrame:
    """Rows without a vector or with a stale one: tenant_id, id, text."""
    rows = df if tenant is None else df.filter(F.col("tenant_id") == tenant)
    return rows.filter(is_pending()).select("tenant_id", "id", F.col(text).alias("text"))


def embed(
    rows: DataFrame,
    embedder: Embedder,
    *,
    dimensions: int = DIMENSIONS,
    batch: int = BATCH,
    max_chars: int | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Vectors for the rows of :func:`pending`: tenant_id, id, text_hash, vector.

    The embedder runs in the tasks, ``batch`` texts per call.  A vector of another
    length fails the job.  Texts are embedded whole; a service with a limit
    splits them itself, or the caller cuts them at ``max_chars``.  ``parallelism``
    spreads few large partitions over more tasks when calls are slow.
    """
    text = F.coalesce("text", F.lit(""))
    cut = text if max_chars is None else F.substring(text, 1, max_chars)
    prepared = rows.select("tenant_id", "id", F.xxhash64(text).alias("text_hash"), cut.alias("text"))
    if parallelism:
        prepared = prepared.repartition(parallelism, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(embedder(part["text"].tolist()), dtype=np.float64)
                if vectors.shape != (len(part), dimensions):
                    raise ValueError(f"embedder gave {vectors.shape}, expected {(len(part), dimensions)}")
                out = part[["tenant_id", "id", "text_hash"]].copy()
                out["vector"] = list(np.round(vectors, DECIMALS).astype(np.float32))
                yield out

    key = dict(rows.dtypes)["id"]
    return prepared.mapInPandas(run, f"tenant_id string, id {key}, text_hash long, vector array<float>")


def apply_embeddings(df: DataFrame, vectors: DataFrame, text: str, model: str, run_ts) -> DataFrame:
    """New tier snapshot with the vectors written in.

    A row whose text changed after it was read stays stale.
    """
    fresh = vectors.select("tenant_id", "id", "text_hash", "vector")
    joined = df.join(fresh, ["tenant_id", "id"], "left")
    hit = F.col("vector").isNotNull()
    current = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("text_hash")
    new = {
        "embedding": F.when(hit, F.col("vector")).otherwise(F.col("embedding")),
        "embedding_stale": F.when(hit, ~current).otherwise(F.col("embedding_stale")),
        "model_version": F.when(hit, F.lit(model)).otherwise(F.col("model_version")),
        "embedded_at": F.when(hit, F.lit(run_ts).cast(dict(df.dtypes)["embedded_at"])).otherwise(F.col("embedded_at")),
    }
    return joined.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in df.columns])


def refresh(df: DataFrame, text: str, embedder: Embedder, model: str, run_ts, **options) -> DataFrame:
    """Tier snapshot with every pending row embedded.

    The vectors are stored before they are joined in: the loss of an executor
    later on never repeats a call to the embedder.
    """
    vectors = kept(embed(pending(df, text), embedder, **options), "vectors")
    return apply_embeddings(df, vectors, text, model, run_ts)


def pending_counts(T) -> DataFrame:
    """Pending rows per tier and tenant."""
    tiers = [
        T[t].groupBy("tenant_id").agg(F.count(F.when(is_pending(), 1)).alias("pending")).select(
            F.lit(t).alias("tier"), "tenant_id", "pending"
        )
        for t in ("semantic_index", "document_chunks")
    ]
    return tiers[0].unionByName(tiers[1])


class CodePointEmbedder:
    """Deterministic stand-in for an embedding service: code point counts, length one."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            points = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
            out[i] = np.bincount(points % self.dimensions, minlength=self.dimensions)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)
