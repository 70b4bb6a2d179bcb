"""Approximate nearest neighbours by cosine with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE_ROWS`` distinct vectors at most) and holds every row: rows go
down to a leaf each. A query visits leaves in the order of a priority queue over tree nodes. How many it visits
is calibrated: the exact neighbours of ``CALIBRATION`` queries are found over all rows, and visits are widened
until their recall reaches ``RECALL``. Leaves are cut into chunks of bounded size and so are the queries that
visit one leaf, so neither a common vector nor a popular leaf lands in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import arrow_map, only, table, written

K = 5
SAMPLE_ROWS = 65_536
LEAF_ROWS = 256
SAMPLE_PER_LEAF = 8
BRANCH = 16
CALIBRATION = 256
RECALL = 0.97
CHUNK_ROWS = 4_096
CHUNK_QUERIES = 8_192
ROUNDS = 10

# -- tree -----------------------------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centres, place of each row)."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres, (x @ centres.T).argmax(axis=1)


class Tree:
    """Nodes as arrays: the centres of a node's children and their numbers; leaves have a number from 0."""

    def __init__(self, centres: dict[int, np.ndarray], children: dict[int, list[int]], leaf: dict[int, int]):
        self.centres, self.children, self.leaf = centres, children, leaf

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 0) -> Tree:
        """At most about ``leaves`` leaves over the distinct rows of a sample of unit vectors."""
        x = np.unique(sample, axis=0) if len(sample) else sample
        self = cls({}, {}, {})
        nodes, todo = 1, [(0, x, leaves)]
        while todo:
            node, own, n = todo.pop()
            k = min(branch, n, len(own))
            if k < 2:
                self.leaf[node] = len(self.leaf)
                continue
            centres, at = _kmeans(own, k, seed + node)
            used = np.unique(at)
            if len(used) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            self.centres[node] = centres[used]
            self.children[node] = list(range(nodes, nodes + len(used)))
            nodes += len(used)
            for child, c in zip(self.children[node], used):
                share = max(1, round(n * (at == c).sum() / len(own)))
                todo.append((child, own[at == c], share))
        return self

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down to the nearest child."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            else:
                at = (x[rows] @ self.centres[node].T).argmax(axis=1)
                todo += [(c, rows[at == k]) for k, c in enumerate(self.children[node]) if (at == k).any()]
        return out

    def order(self, q: np.ndarray):
        """Leaves, best bin first: the queue holds nodes by their centre's cosine to the query."""
        heap = [(-1.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                yield self.leaf[node]
            else:
                for near, child in zip((self.centres[node] @ q).tolist(), self.children[node]):
                    heapq.heappush(heap, (-near, child))


# -- vectors --------------------------------------------------------------------------------------------------


def _kind(df: DataFrame, column: str) -> str:
    return "<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8"


def usable(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, str]:
    """(id, v as bytes) of the rows that take part, and the numbers' type in v.

    Out: null ids; vectors null, zero, or with a null or non-finite component, or of a length that isn't the most common.
    """
    kind = _kind(df, vector)

    def make():
        def f(batch):
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            keep, raw, dim = [], [], []
            for k, (i, v) in enumerate(zip(ids, rows)):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy()
                if np.isfinite(x).all() and x.any():
                    keep.append(k)
                    raw.append(x.astype(kind).tobytes())
                    dim.append(len(x))
            return {"id": [ids[k] for k in keep], "v": raw, "dim": dim}

        return f

    own = only(df, id_, vector)
    own = own.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    return arrow_map(own, "id long, v binary, dim int", make, 2_048), kind


def _matrix(raw, kind: str) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of a vector to each row, in double precision; equal rows get equal numbers wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of ``x`` for each query but its own id: largest cosine, then smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # Equal vectors: the k + 1 smallest ids are enough.
    flat = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, same = np.unique(flat, return_index=True, return_inverse=True)
    by = np.argsort(same, kind="stable")
    starts = np.searchsorted(same[by], np.arange(len(first)))
    nth = np.arange(len(by)) - starts[same[by]]
    few = by[nth <= k]
    few = few[np.argsort(same[few], kind="stable")]
    at = np.searchsorted(same[few], np.arange(len(first) + 1))
    u, unit_u = x[first], unit(x[first])
    out = []
    for s in range(0, len(q), 512):
        near = unit(q[s : s + 512]) @ unit_u.T
        most = min(k + 1, near.shape[1])
        floor = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
        for n, row in enumerate(near):
            pick = np.flatnonzero(row >= floor[n] - 1e-9)
            score = cosines(q[s + n], u[pick])
            own = np.concatenate([few[at[p] : at[p + 1]] for p in pick])
            score = np.repeat(score, at[pick + 1] - at[pick])
            found = ids[own]
            ok = found != qids[s + n]
            found, score = found[ok], score[ok]
            top = np.lexsort((found, -score))
            top = top[np.sort(np.unique(found[top], return_index=True)[1])[:k]] if len(top) else top
            out.append((np.full(len(top), qids[s + n]), found[top], score[top]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# -- search ---------------------------------------------------------------------------------------------------


def fit(vectors: DataFrame, kind: str, rows: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over the ``sample_rows`` rows whose ids hash lowest: the same rows on any partitioning."""
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).select("v").toPandas()["v"]
    x = unit(_matrix(sample, kind)) if len(sample) else np.zeros((0, 1))
    return Tree.fit(x, max(1, min(rows // leaf_rows, len(x) // SAMPLE_PER_LEAF)))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    id_: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    recall: float = RECALL,
    calibration: int = CALIBRATION,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``df`` found for each row of ``queries``.

    Both have columns ``id_`` and ``vector``; others are ignored. Nearest is the largest cosine of the vectors as
    given, in double precision, ties to the smaller id; a row with the query's id is no candidate. Rows of
    ``usable`` alone take part. Repeated rows are found, and answered, once. Fewer than k candidates: all of them.
    No rows: no rows.
    """
    spark = df.sparkSession
    found, kind = usable(df, id_, vector)
    found = written(found, "ann-usable")
    dims = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = found.where(F.col("dim") == dims["dim"]).select("id", "v")
    asked, _ = usable(queries, id_, vector)
    asked = written(asked.where(F.col("dim") == dims["dim"]).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    tree = spark.sparkContext.broadcast(fit(vectors, kind, dims["count"], sample_rows, leaf_rows))  # at most sample_rows / SAMPLE_PER_LEAF centres

    def placed():
        return lambda b: {"id": b.column("id"), "v": b.column("v"), "leaf": pa.array(tree.value.place(unit(_matrix(b.column("v").to_pylist(), kind))))}

    rows = written(arrow_map(vectors, "id long, v binary, leaf long", placed, 4_096), "ann-leaves")
    sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.countDistinct("id").alias("n")).collect()}  # a row a leaf
    visits = _calibrated(spark, rows, asked, tree, kind, k, recall, calibration, sizes)
    held = spark.sparkContext.broadcast((visits, sizes))

    def visited():
        most, count = held.value

        def f(batch):
            out = {"query_id": [], "q": [], "leaf": []}
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                q, seen = np.frombuffer(v, kind).astype(np.float64), 0
                for n, leaf in enumerate(tree.value.order(q / np.linalg.norm(q))):
                    if n >= most and seen > k:
                        break
                    seen += count.get(leaf, 0)
                    if leaf in count:
                        for c, x in zip(out, (i, v, leaf)):
                            out[c].append(x)
            return out

        return f

    going = written(arrow_map(asked, "query_id long, q binary, leaf long", visited, 256), "ann-visits")
    asks = {r["leaf"]: r["count"] for r in going.groupBy("leaf").count().collect()}  # a row a leaf
    cuts = spark.createDataFrame([(leaf, -(-n // CHUNK_ROWS), -(-asks[leaf] // CHUNK_QUERIES)) for leaf, n in sizes.items() if leaf in asks], "leaf long, chunks int, parts int")
    cuts = F.broadcast(cuts)  # a row a leaf
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.join(cuts, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("part", each(F.col("parts"))).select("leaf", "chunk", "part", "id", "v")
    right = going.join(cuts, "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("chunk", each(F.col("chunks"))).select("leaf", "chunk", "part", "query_id", "q")

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        return best(q["query_id"].to_numpy(), _matrix(q["q"], kind), x["id"].to_numpy(), _matrix(x["v"], kind), k)

    by = ["leaf", "chunk", "part"]
    out = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    return _top(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(spark: SparkSession, rows: DataFrame, asked: DataFrame, tree, kind: str, k: int, recall: float, calibration: int, sizes: dict[int, int]) -> int:
    """How many leaves must be visited for the wanted mean recall of ``calibration`` queries' exact neighbours over all rows."""
    few = asked.orderBy(F.xxhash64("id"), "id").limit(calibration).toPandas()
    if len(few) == 0 or len(sizes) < 2:
        return len(sizes)
    sent = spark.sparkContext.broadcast((few["id"].to_numpy(), _matrix(few["v"], kind)))

    def exact():
        qids, q = sent.value

        def f(batch):
            made = best(qids, q, batch.column("id").to_numpy(), _matrix(batch.column("v").to_pylist(), kind), k)
            leaf = dict(zip(batch.column("id").to_pylist(), batch.column("leaf").to_pylist()))
            return {c: pa.array(made[c].to_numpy()) for c in made} | {"leaf": [leaf[i] for i in made["vec_id"].tolist()]}

        return f

    found = arrow_map(rows, "query_id long, vec_id long, score double, leaf long", exact, 8_192)
    found = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("x")).select("query_id", "vec_id", "x.score", "x.leaf")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "leaf").toPandas()  # calibration * k rows at most
    place = {}
    for i, v in zip(few["id"], _matrix(few["v"], kind)):
        place[i] = {leaf: n for n, leaf in enumerate(tree.value.order(v / np.linalg.norm(v)))}
    need = np.sort([place[i][leaf] for i, leaf in zip(truth["query_id"], truth["leaf"])])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else len(sizes)


# -- query ----------------------------------------------------------------------------------------------------


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
