"""Plug points of models: embedding, pair scoring, generation. The engine calls them in Arrow batches; doubles stand in for tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

Embedder = Callable[[list[str]], np.ndarray]
PairScorer = Callable[[list[str], list[str]], np.ndarray]


def embed(make: Callable[[], Embedder], dim: int) -> Callable[[Column], Column]:
    """A column function: ``make`` runs once a task; vectors must be finite, not zero and of ``dim`` numbers."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            x = np.asarray(model([t or "" for t in part]), np.float32) if len(part) else np.zeros((0, dim), np.float32)
            if x.shape != (len(part), dim) or not np.isfinite(x).all() or (len(x) and (np.linalg.norm(x, axis=1) == 0).any()):
                raise ValueError("an embedder gives one finite vector, not zero, for each text")
            yield pd.Series(list(x))

    return run


def score_pairs(make: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """A column function of (query, text); scores must be finite, one for each pair."""

    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, d in parts:
            s = np.asarray(model(list(q), list(d)), np.float64)
            if s.shape != (len(q),) or not np.isfinite(s).all():
                raise ValueError("a scorer gives one finite number for each pair")
            yield pd.Series(s)

    return run


class HashingEmbedder:
    """A double: signed hashes of a text's words, so equal texts have equal vectors and alike texts near ones."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for n, t in enumerate(texts):
            for w in t.lower().split() or [""]:
                h = xxhash.xxh64_intdigest(w)
                out[n, h % self.dim] += 1 if h >> 32 & 1 else -1
            if not out[n].any():
                out[n, 0] = 1
        return out


class OverlapScorer:
    """A double: the share of the query's words that the text has."""

    def __call__(self, queries: list[str], texts: list[str]) -> np.ndarray:
        a, b = ([set((x or "").lower().split()) for x in xs] for xs in (queries, texts))
        return np.array([len(x & y) / len(x) if x else 0.0 for x, y in zip(a, b)])


def extractive_answers(evidence: DataFrame, k: int = 2) -> DataFrame:
    """query_id, answer, evidence_ids: a generator's double that quotes the first ``k`` pieces of evidence (query_id, doc_id, rank, text)."""
    few = evidence.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("e"))
    return few.select("query_id", F.array_join(F.transform("e", lambda x: F.substring(x["text"], 1, 200)), "\n").alias("answer"), F.transform("e", lambda x: x["doc_id"]).alias("evidence_ids"))


def batch_size(memory_mb: float) -> int:
    """Rows a batch for an accelerator's memory: the largest that fits with both models held."""
    for least, size in ((24_000, 64), (12_000, 32), (8_000, 16), (4_000, 8)):
        if memory_mb >= least:
            return size
    return 4
