"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network.

Each token (a word's letters, or the shape of the word: case, digits, punctuation) falls in one of ``BUCKETS``
hash buckets, so every word of every document counts and memory is bounded. A bucket has a sparse random index
vector; its word vector is the sum of the index vectors of the tokens around its occurrences over the whole
corpus. A document's vector pools its tokens' word vectors. A two-layer numpy network is fitted on at most
``MAX_LABELS`` labelled rows, and its logits are divided by a temperature fitted on rows that it didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import arrow_map, only, table
from corpusloom.llm.sums import summed
from corpusloom.llm.words import batches, hashes

BUCKETS = 1 << 13
DIM = 48
NONZERO = 2
WINDOW = 2
MAX_LABELS = 20_000
HIDDEN = 32
FOLDS, HELD_OUT = 3, 1

# -- tokens ---------------------------------------------------------------------------------------------------

#: Bucket 0 stands between documents and is no token; bucket 1 follows a word that repeats the one before.
_BREAK, _AGAIN = 0, 1
#: A word's shape: its runs of capitals, of other letters and of digits each become one sign; other signs stay as they are.
_RUNS = ((r"\p{Lu}{2,}", "\x02"), (r"\p{Lu}", "\x03"), (r"[\p{L}\p{M}]+", "\x04"), (r"\p{N}+", "\x05"))


def word_tokens(words: pa.Array) -> np.ndarray:
    """For each word the buckets of its letters, lower-cased, and of its shape."""
    words = words.cast(pa.large_string())
    letters = pc.utf8_lower(words)
    plain = pc.utf8_is_alpha(words)
    other = pc.invert(plain)
    letters = pc.replace_with_mask(letters, other, pc.replace_substring_regex(letters.filter(other), r"[^\p{L}\p{M}]+", ""))
    shape = words
    for pattern, sign in _RUNS:
        shape = pc.replace_substring_regex(shape, pattern, sign)
    found = np.stack([hashes(letters, 7), hashes(shape, 8)], axis=1)
    return (found % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def token_batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of buckets up to each text's end) of runs of a column's texts.

    In reading order: letters, shape for each word; a word that repeats the one before has the shape "again". Null: none.
    """
    for places, words, ends in batches(column):
        out = word_tokens(words)[places]
        again = np.flatnonzero(out[1:, 0] == out[:-1, 0]) + 1
        first = np.zeros(len(out) + 1, bool)
        first[ends] = True
        out[again[~first[again]], 1] = _AGAIN
        yield out.ravel(), 2 * ends


def tokens(text: str) -> np.ndarray:
    """The buckets of one text."""
    return next(token_batches(pa.array([text])))[0]


# -- word vectors ---------------------------------------------------------------------------------------------


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each bucket's index vector: ``NONZERO`` entries of 1 or -1. The break has none."""
    rng = np.random.default_rng(11)
    places = rng.integers(0, DIM, (BUCKETS, NONZERO))
    signs = rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))
    signs[_BREAK] = 0
    return places, signs


def context_sums(docs: DataFrame) -> np.ndarray:
    """For each bucket, the sum of the index vectors around its occurrences in all documents: int64, BUCKETS x DIM."""

    def make():
        places, signs = index_vectors()
        # A bucket's entries as places of a row: plus, minus, and one at the end for the break's, which count nowhere.
        wide = 2 * DIM + 1
        code = np.where(signs == 0, 2 * DIM, 2 * places + (signs < 0))

        def add(batch, total):
            for found, ends in token_batches(batch.column("text")):
                own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                seq = np.zeros(len(found) + WINDOW * len(ends), np.int64)
                seq[np.arange(len(found)) + WINDOW * own] = found
                for at in range(0, len(seq), 1 << 18):
                    near, flat = seq[max(0, at - WINDOW) : at + (1 << 18)], []
                    for d in range(1, WINDOW + 1):
                        a, b = near[:-d], near[d:]
                        if at:  # pairs that end before this stretch were counted
                            a, b = a[WINDOW - d :], b[WINDOW - d :]
                        flat += [(x[:, None] * wide + code[y]).ravel() for x, y in ((a, b), (b, a))]
                    count = np.bincount(np.concatenate(flat), minlength=BUCKETS * wide).reshape(BUCKETS, wide)
                    total += (count[:, : 2 * DIM : 2] - count[:, 1 : 2 * DIM : 2]).ravel()
            total[:DIM] = 0

        return add

    return summed(only(docs, "text"), BUCKETS * DIM, make).reshape(BUCKETS, DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    x = sums.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1.0)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean, spread, least and largest of its word vectors, and the log of its length. No words: zeros.

    A text's distinct tokens are at most ``BUCKETS``.
    """
    out, both = [], np.concatenate([vectors, vectors * vectors], axis=1)
    for found, ends in token_batches(column):
        size = np.diff(ends, prepend=0)
        key, count = np.unique(np.repeat(np.arange(len(ends)), size) * BUCKETS + found, return_counts=True)
        own, token = key // BUCKETS, key % BUCKETS
        share = (count / size[own]).astype(np.float32)
        made = np.zeros((len(ends), 4 * DIM + 1), np.float32)
        made[:, -1] = np.log1p(size) / 10
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for row, i, j in zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)]):
            x = both[token[i:j]]
            made[row, : 2 * DIM] = share[i:j] @ x
            np.min(x[:, :DIM], axis=0, out=made[row, 2 * DIM : 3 * DIM])
            np.max(x[:, :DIM], axis=0, out=made[row, 3 * DIM : 4 * DIM])
        mean = made[:, :DIM]
        made[:, DIM : 2 * DIM] = np.sqrt(np.maximum(made[:, DIM : 2 * DIM] - mean * mean, 0))
        out.append(made)
    return np.concatenate(out) if out else np.zeros((0, 4 * DIM + 1), np.float32)


def features(docs: DataFrame, vectors: np.ndarray, carry: tuple[str, ...]) -> DataFrame:
    """The pooled vectors, as binary float32, with ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * DIM floats

    def make():
        return lambda b: {c: b.column(c) for c in carry} | {"x": [x.tobytes() for x in pooled(b.column("text"), sent.value)]}

    kinds = {f.name: f.dataType for f in docs.schema}
    return arrow_map(only(docs, "text", *carry), T.StructType([*[T.StructField(c, kinds[c]) for c in carry], T.StructField("x", T.BinaryType())]), make, 2048)


# -- network --------------------------------------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Inputs scaled to unit spread, a layer of tanh, a logit over a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 0) -> Network:
        """Adam on the log loss with a little weight decay; the temperature is fitted on every fifth row, which the weights never see."""
        rng = np.random.default_rng(seed)
        aside = np.arange(len(x)) % 5 == 4
        if len(set(y[~aside].tolist())) < 2 or not aside.any():
            aside[:] = False
        fx, fy = x[~aside], y[~aside]
        mean, scale = fx.mean(axis=0), fx.std(axis=0) + 1e-3
        z = np.clip((fx - mean) / scale, -8, 8)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        size = 128 if len(z) > 2000 else 32
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-5
            order = rng.permutation(len(z))
            for at in range(0, len(z), size):
                rows = order[at : at + size]
                zx, h = z[rows], np.tanh(z[rows] @ p[0] + p[1])
                d = (sigmoid(h @ p[2] + p[3]) - fy[rows]) / len(rows)
                dh = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((zx.T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ d + 1e-3 * p[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = cls(mean, scale, p[0], p[1], p[2], p[3][0])
        if aside.any() and len(set(y[aside].tolist())) > 1:
            z, t = net.logits(x[aside]), y[aside]
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [-np.mean(t * np.log(s := np.clip(sigmoid(z / k), 1e-9, 1 - 1e-9)) + (1 - t) * np.log(1 - s)) for k in tries]
            net.temperature = float(tries[int(np.argmin(loss))])
        return net


class Constant:
    """Where there are no labels, or one class alone: one score for all."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


# -- operator -------------------------------------------------------------------------------------------------


def fold(folds: int) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def sampled_labels(labels: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y): at most ``most`` labelled documents outside the held-out fold, those whose ids hash lowest. Nulls are no labels; repeated rows vote."""
    own = only(labels, "doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(folds) != held_out))
    return own.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_labels: int = MAX_LABELS) -> Network | Constant:
    known = sampled_labels(labels, "quality", FOLDS, HELD_OUT, max_labels)
    found = features(only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id"), vectors, ("doc_id", "y"))
    rows = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()  # max_labels rows at most
    if not len(rows):
        return Constant(0.5)
    y = rows["y"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    order = np.random.default_rng(5).permutation(len(y))
    return Network.fit(np.stack([np.frombuffer(r, np.float32) for r in rows["x"]]).astype(float)[order], y[order])


def scored(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, ``carry`` and score: the probability that a document's quality is 1.

    Word vectors come from all of ``docs``, labels from rows outside the held-out fold (crc32 of doc_id, mod 3, is
    1). Null and empty texts get the score of a document without words. Very long texts are read whole, in memory in
    proportion to one text. Null doc_id: scored, never a label. Repeated rows: scored alike. Without labels every score is 0.5, with one class alone that class's smoothed
    share. Other columns are ignored. No rows: no rows.
    """
    vectors = word_vectors(context_sums(docs))
    model = fit(docs, labels, vectors, max_labels)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, model))
    own = only(docs, "doc_id", "text", *[c for c in carry if c != "text"])

    def make():
        vecs, net = sent.value

        def f(batch):
            x = pooled(batch.column("text"), vecs).astype(float)
            return {c: batch.column(c) for c in ("doc_id", *carry)} | {"score": pa.array(net.score(x))}

        return f

    kinds = {f.name: f.dataType for f in own.schema}
    return arrow_map(own, T.StructType([*[T.StructField(c, kinds[c]) for c in ("doc_id", *carry)], T.StructField("score", T.DoubleType())]), make, 2048)


# -- query ----------------------------------------------------------------------------------------------------


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
