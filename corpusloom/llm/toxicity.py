"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, whatever their labels, are the unlabelled set. A word
falls in hash buckets (itself and its first letters), one in each of two tables, so a word that shares a bucket
with a telling word in one table is told apart by the other. For each bucket the share of positives and of all documents
that hold it gives a log-ratio to a negative's share, which the class prior corrects: unlabelled = prior * positive
+ (1 - prior) * negative. Documents are described by their words' largest ratios, and a two-layer numpy network is
trained on them with the non-negative risk estimator, so unlabelled toxic documents aren't taken for negatives.

All documents count in the unlabelled risk: alike descriptions share one of ``SLOTS`` slots, which holds how many
documents it has and the sum of their descriptions.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import arrow_map, only, table, texts
from corpusloom.llm.quality import Constant, fold, sampled_labels, sigmoid
from corpusloom.llm.sums import summed
from corpusloom.llm.words import batches, distinct, hashes

TABLE = 1 << 17
TABLES = 2
BUCKETS = TABLE * TABLES
STEMS = (4, 5)
SIGNS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»–—…¡¿"""
SURPRISE = 5.0
COPY_WORDS = 5
SKETCH, SAME = 16, 12
MAX_POSITIVES = 20_000
TOP = 5
SLOTS = 1 << 14
GRID, SCALE = 4, 1024
HIDDEN = 8
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PRIOR = 0.1  # where no label tells

# -- words ----------------------------------------------------------------------------------------------------


def word_buckets(words: pa.Array) -> np.ndarray:
    """For each lower-cased word, without signs at its ends, for it and its first letters: a bucket of each table."""
    core = pc.utf8_trim(words.cast(pa.large_string()), characters=SIGNS)
    found = [hashes(core, 3), *[hashes(pc.utf8_slice_codeunits(core, 0, n), 3 + n) for n in STEMS]]
    return np.stack([np.stack([h % np.uint64(TABLE), (h >> np.uint64(32)) % np.uint64(TABLE) + np.uint64(TABLE)], axis=1) for h in found], axis=1).astype(np.int64)


def buckets(text: str) -> np.ndarray:
    """The buckets of one text's words."""
    places, words, _ = next(batches(pa.array([text]), lower=True))
    return word_buckets(words)[np.unique(places)]


def sketch(text: str) -> list[int]:
    """The least of ``SKETCH`` hashes of the runs of ``COPY_WORDS`` words; texts share about as large a part of them as of their runs."""
    words = text.lower().split()
    runs = [xxhash.xxh64_intdigest(" ".join(words[i : i + COPY_WORDS]).encode("utf-8", "surrogatepass"), 5) for i in range(max(1, len(words) - COPY_WORDS + 1))]
    h = np.array(runs, np.uint64)
    out = []
    for k in range(SKETCH):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((x ^ (x >> np.uint64(29))).min() >> np.uint64(1)))
    return out


def apart(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """Positives without those like one of a smaller id: else each word that copies share would look like a sign of toxicity."""

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "sketch": [sketch(t) for t in texts(b)]}

    own = only(docs, "doc_id", "text").join(F.broadcast(positives), "doc_id")  # max_positives rows at most
    found = arrow_map(own, "doc_id long, sketch array<long>", make, 256).groupBy("doc_id").agg(F.min("sketch").alias("sketch"))
    kept, of = [], {}
    for doc, own in sorted((r["doc_id"], r["sketch"]) for r in found.collect()):  # max_positives rows at most
        seen = Counter(i for k, x in enumerate(own) for i in of.get((k, x), ()))
        if max(seen.values(), default=0) < SAME:
            kept.append((doc, 1))
            for k, x in enumerate(own):
                of.setdefault((k, x), []).append(doc)
    return docs.sparkSession.createDataFrame(kept, "doc_id long, y int")


# -- ratios ---------------------------------------------------------------------------------------------------


def half(doc_id: int | None) -> int:
    return 0 if doc_id is None else xxhash.xxh64_intdigest(int(doc_id).to_bytes(8, "little", signed=True), 9) & 1


def counts(docs: DataFrame, positives: DataFrame) -> np.ndarray:
    """How many documents hold each bucket: [all or positive, half of the ids, bucket]; the last 64 places count documents."""

    def make():
        def add(batch, total):
            view = total[: 4 * BUCKETS].reshape(2, 2, BUCKETS)
            halves, marks = [half(d) for d in batch.column("doc_id").to_pylist()], batch.column("y").to_pylist()
            row = 0
            for places, words, ends in batches(batch.column("text"), lower=True):
                of, at = word_buckets(words).reshape(-1, (1 + len(STEMS)) * TABLES), 0
                for end in ends.tolist():
                    h, own = halves[row], of[places[at:end]].ravel()
                    for kind in (0, 1) if marks[row] else (0,):
                        view[kind, h, own] += 1  # += counts a place once, however often it is named
                        total[4 * BUCKETS + 2 * kind + h] += 1
                    row, at = row + 1, end

        return add

    flagged = only(docs, "doc_id", "text").join(F.broadcast(positives.select("doc_id", "y")), "doc_id", "left")  # MAX_POSITIVES rows at most
    return summed(flagged, 4 * BUCKETS + 64, make)


def ratios(found: np.ndarray, halves: list[int], prior: float) -> np.ndarray:
    """Log-ratio of a bucket's share among positives to its corrected share among negatives, less a standard error; 0 where that is below 0 or may be chance."""
    view = found[: 4 * BUCKETS].reshape(2, 2, BUCKETS)[:, halves].sum(axis=1).astype(float)
    every, positive = (found[4 * BUCKETS + 2 * k : 4 * BUCKETS + 2 * k + 2][halves].sum() for k in range(2))
    p = (view[1] + 0.25) / (positive + 0.5)
    u = view[0] / max(1, every)
    expected = np.maximum((u - prior * view[1] / max(1, positive)) / (1 - prior), 0) * (1 - prior) * every
    n = (expected + 0.5) / ((1 - prior) * every + 1)
    error = np.sqrt(1 / (view[1] + 0.25) + 1 / (expected + 1))
    # Chernoff's exponent for so many positives by chance.
    chance = np.maximum(positive * u, 1e-9)
    surprise = view[1] * np.log(np.maximum(view[1], 1e-9) / chance) - (view[1] - chance)
    sure = (view[1] >= 2) & (view[1] > chance) & (surprise > SURPRISE)
    return (np.maximum(np.log(p / n) - error, 0) * sure).astype(np.float32)


def described(column: pa.Array, by: list[np.ndarray], which: np.ndarray | None = None) -> np.ndarray:
    """For each text the ``TOP`` largest of its distinct words' ratios, how many exceed 1 and 2, their sum's and the length's logs. No words: zeros.

    ``which`` of the tables of ratios ``by`` is a text's; None: the first.
    """
    out, row = [], 0
    for places, words, ends in batches(column, lower=True):
        at = word_buckets(words)
        ratio = np.stack([r[at].min(axis=2).max(axis=1) for r in by])
        own, place = distinct(places, len(words), ends)
        mine = np.zeros(len(ends), np.int64) if which is None else which[row : row + len(ends)]
        value = ratio[mine[own], place]
        made = np.zeros((len(ends), TOP + 4), np.float32)
        made[:, -1] = np.bincount(own, minlength=len(ends))
        own, value = own[value > 0], value[value > 0]
        order = np.lexsort((-value, own))
        own, value = own[order], value[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        made[own[rank < TOP], rank[rank < TOP]] = value[rank < TOP]
        for k, weight in enumerate((value > 1, value > 2, np.where(value > 1, value, 0))):
            made[:, TOP + k] = np.bincount(own, weight, len(ends))
        made[:, TOP:] = np.log1p(made[:, TOP:])
        out.append(made)
        row += len(ends)
    return np.concatenate(out) if out else np.zeros((0, TOP + 4), np.float32)


def slots(x: np.ndarray) -> np.ndarray:
    """The slot of each description: a hash of its values in steps of 1 / ``GRID``."""
    h = np.zeros(len(x), np.uint64)
    for c in np.floor(x * GRID).astype(np.int64).T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(SLOTS)).astype(np.int64)


def unlabelled(docs: DataFrame, by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(mean description, number of documents) of each slot with documents; all of ``docs`` count."""
    sent = docs.sparkSession.sparkContext.broadcast(by)  # 2 * BUCKETS floats
    wide = TOP + 5

    def make():
        def add(batch, total):
            x = described(batch.column("text"), sent.value, np.array([half(d) for d in batch.column("doc_id").to_pylist()], np.int64))
            at, whole = slots(x), np.rint(x.astype(float) * SCALE).astype(np.int64)
            np.add.at(total.reshape(SLOTS, wide), at, np.concatenate([np.ones((len(x), 1), np.int64), whole], axis=1))

        return add

    found = summed(only(docs, "doc_id", "text"), SLOTS * wide, make).reshape(SLOTS, wide)
    found = found[found[:, 0] > 0].astype(float)
    return found[:, 1:] / found[:, :1] / SCALE, found[:, 0]


# -- risk -----------------------------------------------------------------------------------------------------


class Risk:
    """Two layers, trained by non-negative positive-unlabelled risk with the logistic loss."""

    def __init__(self, mean, scale, p):
        self.mean, self.scale, self.p = mean, scale, p

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return sigmoid(np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])

    @classmethod
    def fit(cls, positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: np.ndarray | None = None, hidden: int = HIDDEN, steps: int = 1500, seed: int = 0) -> Risk:
        """Full-batch Adam; an unlabelled row counts by its ``weight``. While the estimated risk of the negatives is below zero, its own gradient is climbed instead."""
        rng = np.random.default_rng(seed)
        share = np.full(len(unlabelled), 1 / len(unlabelled)) if weight is None else weight / weight.sum()
        mean = share @ unlabelled
        scale = np.sqrt(share @ (unlabelled - mean) ** 2) + 1e-2
        xp, xu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
        p = [rng.normal(0, 0.4, (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.4, hidden), np.array([np.log(prior / (1 - prior))])]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, steps + 1):
            hp, hu = (np.tanh(x @ p[0] + p[1]) for x in (xp, xu))
            sp, su = sigmoid(hp @ p[2] + p[3]), sigmoid(hu @ p[2] + p[3])
            negative = -share @ np.log(np.clip(1 - su, 1e-12, 1)) + prior * np.log(np.clip(1 - sp, 1e-12, 1)).mean()
            # d loss(positive) = s - 1, d loss(negative) = s, each over its logit
            up, uu = -prior * sp / len(sp), su * share
            gp, gu = (prior * (sp - 1) / len(sp) + up, uu) if negative >= 0 else (-up, -uu)
            dhp, dhu = np.outer(gp, p[2]) * (1 - hp * hp), np.outer(gu, p[2]) * (1 - hu * hu)
            rate = 0.02 * (1 - step / (steps + 1))
            for k, g in enumerate((xp.T @ dhp + xu.T @ dhu + 1e-4 * p[0], dhp.sum(axis=0) + dhu.sum(axis=0), hp.T @ gp + hu.T @ gu + 1e-4 * p[2], np.array([gp.sum() + gu.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(mean, scale, p)


# -- operator -------------------------------------------------------------------------------------------------


def scored(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), prior: float | None = None, max_positives: int = MAX_POSITIVES) -> DataFrame:
    """doc_id, ``carry`` and score: the probability that a document is toxic.

    Word counts and the unlabelled risk cover all of ``docs``. At most ``max_positives`` confirmed toxic rows outside
    the held-out fold (crc32 of doc_id, mod 4, is 2), those whose ids hash lowest, are the positives; of near copies
    among them, one. ``prior`` is the share of toxic documents; None: the labelled rows' share outside the
    held-out fold. Null and empty texts: the score of a document without words. Very long texts are read whole, in
    memory in proportion to one text. Null doc_id: scored, never a label. Repeated rows: scored alike; each counts.
    Without a positive every score is 0. Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    known = only(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS) != HELD_OUT))
    if prior is None:
        share = known.agg(F.avg("toxic")).first()[0]
        prior = PRIOR if share is None else min(0.9, max(1e-3, float(share)))
    positives = sampled_labels(labels.where("toxic = 1"), "toxic", FOLDS, HELD_OUT, max_positives)
    positives = apart(docs, positives)
    own = only(docs, "doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    found = counts(own, positives)
    if not found[4 * BUCKETS + 2 :].any():
        model, ratio = Constant(0.0), np.zeros(BUCKETS, np.float32)
    else:
        # A document's own half doesn't count in the ratios that describe it for training.
        cross = [ratios(found, [1], prior), ratios(found, [0], prior)]
        sent_cross = spark.sparkContext.broadcast(cross)  # 2 * BUCKETS floats
        ratio = ratios(found, [0, 1], prior)

        def describe():
            def f(batch):
                x = described(batch.column("text"), sent_cross.value, np.array([half(d) for d in batch.column("doc_id").to_pylist()], np.int64))
                return {"doc_id": batch.column("doc_id"), "x": [r.tobytes() for r in x]}

            return f

        rows = arrow_map(own.select("doc_id", "text").join(F.broadcast(positives), "doc_id"), "doc_id long, x binary", describe, 2048)
        rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()  # max_positives rows at most
        mean, weight = unlabelled(own, cross)
        model = Risk.fit(np.stack([np.frombuffer(r, np.float32) for r in rows["x"]]).astype(float), mean, prior, weight)
    sent = spark.sparkContext.broadcast((ratio, model))  # BUCKETS floats

    def make():
        by, net = sent.value

        def f(batch):
            x = described(batch.column("text"), [by]).astype(float)
            return {c: batch.column(c) for c in ("doc_id", *carry)} | {"score": pa.array(net.score(x))}

        return f

    kinds = {f.name: f.dataType for f in own.schema}
    return arrow_map(own, T.StructType([*[T.StructField(c, kinds[c]) for c in ("doc_id", *carry)], T.StructField("score", T.DoubleType())]), make, 2048)


# -- query ----------------------------------------------------------------------------------------------------


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
