"""Exact search by cosine over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.lexical import top_k
from corpusloom.sources.sinks import written

#: Queries that one pass over the vectors answers; a batch's vectors are broadcast.
BATCH = 8_192


def normalized(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, unit vector in double precision); null, zero and non-finite vectors are left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    ok = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(ok).select(F.col(id_), x.alias("x"), norm.alias("norm")).where("norm > 0").select(id_, F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, partition: str | None = None, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank (and ``partition``): exact, ties to the smaller id.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding. With ``partition`` each value of that
    column is searched by itself, k rows each, and the lists are merged: the result is the same. Every task
    answers a batch of queries over its rows by one matrix product and sends k rows a query on.
    """
    asked = queries.select("query_id", F.transform("embedding", lambda v: v.cast("double")).alias("v")).where("v is not null").orderBy("query_id")
    n = asked.count()
    if n == 0:
        kind = dict(queries.dtypes)["query_id"]
        empty = queries.sparkSession.createDataFrame([], f"query_id {kind}, vec_id long, score double, rank long")
        return empty.withColumn(partition, F.lit(None).cast(dict(vectors.dtypes)[partition])) if partition else empty
    parts = -(-n // BATCH)
    batches = [asked] if parts == 1 else [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
    found = None
    for batch in batches:
        made = _batch(vectors, batch.toPandas(), dict(queries.dtypes)["query_id"], k, partition, exclude_self)  # BATCH rows at most
        found = made if found is None else found.unionByName(made)
    return written(top_k(found, k, "query_id", "vec_id"), "dense-ranking")  # read more than once by what fuses and compares


def _batch(vectors: DataFrame, asked: pd.DataFrame, kind: str, k: int, partition: str | None, exclude_self: bool) -> DataFrame:
    q = np.array(asked["v"].tolist(), np.float64)
    ids = asked["query_id"].to_numpy()
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))
    own = vectors.select("vec_id", "embedding", *([partition] if partition else [])).where("embedding is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, unit = sent.value
        for part in parts:
            x = np.array(part["embedding"].tolist(), np.float64)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            part, x = part[ok].reset_index(drop=True), x[ok] / norm[ok, None]
            for own in [part.index.to_numpy()] if partition is None else part.groupby(partition).indices.values():
                vec = part["vec_id"].to_numpy()[own]
                for i in range(0, len(qids), 1024):
                    score = np.round(unit[i : i + 1024] @ x[own].T, 6)
                    for n, row in enumerate(score):
                        top = np.lexsort((vec, -row))[: k + 1]
                        top = top[vec[top] != qids[i + n]][:k] if exclude_self else top[:k]
                        out = pd.DataFrame({"query_id": qids[i + n], "vec_id": vec[top], "score": row[top]})
                        if partition:
                            out[partition] = part[partition].to_numpy()[own][top]
                        yield out

    extra = f", {partition} {dict(vectors.dtypes)[partition]}" if partition else ""
    return own.mapInPandas(run, f"query_id {kind}, vec_id long, score double{extra}")
