"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells of source, language and topic. The cells' token shares are raked - scaled to one marginal
after the other, again and again - until they have the wanted shares of every source, language and topic. A
document is then kept with the probability that makes its cell's expected tokens those, scaled so that the
expected total is the wanted part of all tokens although no probability exceeds 1. A document's draw is a hash of
its id, so it is the same in every run.

Topics are the nearest of ``TOPICS`` spherical k-means centres of hashed words. Each round of their fit
is a sum over the distinct word vectors of all documents, so copies count once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import arrow_map, discard, only, table, written
from corpusloom.llm.sums import summed
from corpusloom.llm.words import batches, distinct, hashes

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
HASHED = 256
SCALE = 2.0**20
MAX_CELLS = 200_000
ROUNDS = 200
FRACTION = 0.5
TEMPER = 0.5

# -- topics ---------------------------------------------------------------------------------------------------


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed counts of each text's distinct lower-cased words, its number of words). No words: zeros."""
    counts, sizes = [np.zeros((0, HASHED), np.int64)], [np.zeros(0, np.int64)]
    for places, words, ends in batches(column, lower=True):
        code = (hashes(words, 17) % np.uint64(2 * HASHED)).astype(np.int64)
        own, place = distinct(places, len(words), ends)
        count = np.bincount(own * 2 * HASHED + code[place], minlength=len(ends) * 2 * HASHED).reshape(-1, 2 * HASHED)
        counts.append(count[:, :HASHED] - count[:, HASHED:])
        sizes.append(np.diff(ends, prepend=0))
    return np.concatenate(counts), np.concatenate(sizes)


def vectors(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, raw (the hashed counts), tokens (white-space words) and ``carry``. Null text: no words."""
    own = only(docs, "doc_id", "text", "source", "lang", *[c for c in carry if c not in ("doc_id", "text", "source", "lang")])

    def make():
        def f(batch):
            counts, sizes = hashed(batch.column("text"))
            return {c: batch.column(c) for c in batch.schema.names} | {"__raw": [x.tobytes() for x in counts.astype("<i4")], "tokens": pa.array(sizes)}

        return f

    kinds = {f.name: f.dataType for f in own.schema}
    names = ("doc_id", "source", "lang", *[c for c in carry if c not in ("doc_id", "source", "lang")])
    return arrow_map(own, T.StructType([*[T.StructField(c, kinds[c]) for c in names], T.StructField("__raw", T.BinaryType()), T.StructField("tokens", T.LongType())]), make, 512)


def _counts(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("__raw").to_pylist()), "<i4").reshape(-1, HASHED).astype(float)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def _nearest(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the centre of the largest product; of whole numbers, so that a row's doesn't depend on the rows beside it."""
    return (np.rint(y * SCALE) @ np.rint(centres * SCALE / 2**8).T).argmax(axis=1)


def topic_centres(rows: DataFrame, topics: int = TOPICS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of the distinct word vectors of all ``rows`` (of ``vectors``). Nothing is subtracted.

    It starts from the vectors that hash lowest; each round is a sum over all.
    """
    distinct = written(rows.where("tokens > 0").select("__raw").distinct(), "mixing-vectors")
    few = distinct.orderBy(F.xxhash64("__raw", F.lit(3)), "__raw").limit(topics).collect()  # the starting points
    if not few:
        return np.zeros((1, HASHED))
    centres = _units(np.stack([np.frombuffer(r[0], "<i4") for r in few]).astype(float))
    for _ in range(rounds):

        def members(centres=centres):
            def add(batch, total):
                y = _units(_counts(batch))
                np.add.at(total.reshape(len(centres), HASHED), _nearest(y, centres), np.rint(y * SCALE).astype(np.int64))

            return add

        sums = summed(distinct, centres.size, members, blocks=8).reshape(centres.shape) / SCALE
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        was, centres = centres, np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        if np.array_equal(was, centres):
            break
    return centres


def described(rows: DataFrame, centres: np.ndarray, names: tuple[str, ...]) -> DataFrame:
    """The columns ``names`` of ``rows`` (of ``vectors``), topic and tokens; without words the topic is -1."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def make():
        def f(batch):
            topic, tokens = _nearest(_units(_counts(batch)), sent.value), batch.column("tokens").to_numpy()
            return {c: batch.column(c) for c in (*names, "tokens")} | {"topic": np.where(tokens > 0, topic, -1)}

        return f

    kinds = {f.name: f.dataType for f in rows.schema}
    return arrow_map(only(rows, *names, "__raw", "tokens"), T.StructType([*[T.StructField(c, kinds[c]) for c in names], T.StructField("topic", T.IntegerType()), T.StructField("tokens", T.LongType())]), make, 512)


# -- raking ---------------------------------------------------------------------------------------------------


def rake(shares: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tol: float = 1e-12) -> np.ndarray:
    """Cell shares scaled to each marginal's ``targets`` in turn, until none is off by over ``tol``. ``places``: each cell's place in each marginal."""
    w = shares / shares.sum()
    for _ in range(rounds):
        off = 0.0
        for at, want in zip(places, targets):
            have = np.bincount(at, w, len(want))
            off = max(off, float(np.abs(have - want).max()))
            w = w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[at]
        if off <= tol:
            break
    return w


def rake_frame(cells: DataFrame, rounds: int = ROUNDS, tol: float = 1e-9) -> DataFrame:
    """``rake`` over a table of cells too many for one machine: columns share and, for each of ``DIMENSIONS``, its value and ``want_`` of it.

    Marginals and cells stay distributed; each round is a written table and the one before is deleted.
    """

    def off(w: DataFrame, c: str) -> float:
        have = w.groupBy(c).agg(F.sum("share").alias("h"), F.first(f"want_{c}").alias("g"))
        return have.agg(F.max(F.abs(F.col("h") - F.col("g")))).first()[0] or 0.0

    w = written(cells, "mixing-cells")
    for _ in range(rounds):
        if max(off(w, c) for c in DIMENSIONS) <= tol:
            break
        was = w
        for c in DIMENSIONS:
            have = w.groupBy(F.col(c).alias("__key")).agg(F.sum("share").alias("__have"))
            scale = F.when(F.col("__have") > 0, F.col(f"want_{c}") / F.col("__have")).otherwise(0.0)
            step = written(w.join(have, w[c].eqNullSafe(have["__key"])).withColumn("share", F.col("share") * scale).drop("__key", "__have"), "mixing-cells")
            if w is not was:
                discard(w)
            w = step
        discard(was)
    return w


def probabilities(share: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Each cell's chance: in proportion to wanted over present tokens, 1 at most, so that the expected tokens are ``budget``."""
    ratio = np.divide(share, tokens, out=np.zeros_like(share), where=tokens > 0)
    low, high = 0.0, 1.0
    kept = lambda s: float((tokens * np.minimum(1, s * ratio)).sum())
    budget = min(budget, float(tokens[ratio > 0].sum()))
    while kept(high) < budget * (1 - 1e-12) and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < budget else (low, mid)
    return np.minimum(1, high * ratio)


def scale_of(kept: Callable[[list[float]], list[float]], high: float, budget: float, points: int = 32, rounds: int = 12) -> float:
    """The least scale, up to rounding, at which ``kept`` reaches the budget: each round cuts the range in ``points`` and asks for all of them at once."""
    low = 0.0
    for _ in range(rounds):
        tries = [low + (high - low) * k / points for k in range(1, points)]
        enough = [s for s, x in zip(tries, kept(tries)) if x >= budget]
        cut = enough[0] if enough else high
        low, high = max([low, *[s for s in tries if s < cut]]), cut
    return high


def wanted(cells: DataFrame, total: int, targets: dict[str, dict], temper: float) -> DataFrame:
    """``cells`` with tokens and ``want_`` of each dimension: the share that the cell's value is to have; values that targets leave out get 0.

    The marginals are joined and never collected.
    """
    out = cells
    kinds = dict(cells.dtypes)
    for c in DIMENSIONS:
        have = cells.groupBy(F.col(c).alias("__key")).agg(F.sum("tokens").alias("__have"))
        if targets.get(c):
            given = cells.sparkSession.createDataFrame(list(targets[c].items()), f"__value {kinds[c]}, __given double")
            raw = have.join(given, have["__key"].eqNullSafe(given["__value"]), "left").select("__key", F.coalesce("__given", F.lit(0.0)).alias("__raw"))
        else:
            raw = have.select("__key", F.pow(F.col("__have") / F.lit(float(total)), F.lit(temper)).alias("__raw"))
        norm = raw.agg(F.sum("__raw")).first()[0] or 0.0
        raw = raw.select("__key", (F.col("__raw") / F.lit(norm) if norm else F.lit(0.0)).alias(f"want_{c}"))
        out = out.join(raw, out[c].eqNullSafe(raw["__key"])).drop("__key")
    return out


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), targets: dict[str, dict] | None = None, temper: float = TEMPER, fraction: float = FRACTION, topics: int = TOPICS, max_cells: int = MAX_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, sampled and ``carry`` of every document.

    ``targets`` has wanted shares by dimension and value: present values that it leaves out get no tokens, named ones
    that are absent are ignored. A dimension that isn't there gets its present token shares to the power ``temper``.
    ``weight`` is wanted over present share of the cell's tokens; ``probability`` is calibrated so that the expected
    tokens are ``fraction`` of all; ``sampled`` is the draw. Up to ``max_cells`` cells are raked on the driver, more as
    a table, with the same result. Null source or language: a value of its own. Null or empty text: topic -1, no
    tokens, the chance 1 (it costs nothing) unless its cell has tokens. Very long texts are read whole. Null doc_id:
    drawn as one id. Repeated rows: drawn alike. Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    extra = [c for c in carry if c not in ("doc_id", "source", "lang")]
    found = written(vectors(docs, carry), "mixing-rows")
    centres = topic_centres(found, topics)
    rows = described(found, centres, ("doc_id", "source", "lang", *extra))
    counted = described(found, centres, ("source", "lang")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = written(counted.where("tokens > 0"), "mixing-counts")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    share_of = written(wanted(cells.withColumn("share", F.col("tokens") / F.lit(float(total or 1))), total or 1, targets or {}, temper), "mixing-wanted")
    if share_of.count() <= max_cells:
        got = share_of.orderBy(*DIMENSIONS).toPandas()  # max_cells rows at most
        n, at, goals = got["tokens"].to_numpy(float), [], []
        for c in DIMENSIONS:
            codes, values = pd.factorize(got[c], use_na_sentinel=False)
            want = np.zeros(len(values))
            want[codes] = got[f"want_{c}"]
            at.append(codes)
            goals.append(want)
        share = rake(n / n.sum(), at, goals, rounds) if len(got) else n
        got["weight"] = share / (n / max(n.sum(), 1))
        got["probability"] = probabilities(share, n, fraction * total)
        kept = [(None if pd.isna(s) else s, None if pd.isna(g) else g, int(t), float(w), float(p)) for s, g, t, w, p in got[[*DIMENSIONS, "weight", "probability"]].itertuples(index=False, name=None)]
        chance = F.broadcast(spark.createDataFrame(kept, "source string, lang string, topic int, weight double, probability double"))
    else:
        raked = rake_frame(share_of, rounds)
        ratio = F.col("share") / F.col("tokens")
        ends = raked.where("share > 0").agg(F.min(ratio).alias("least"), F.sum("tokens").alias("tokens")).first()
        scale = 0.0
        if ends["least"]:
            sums = lambda tries: list(raked.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * ratio)) for s in tries]).first())
            scale = scale_of(sums, 1 / ends["least"], min(fraction * total, float(ends["tokens"])) * (1 - 1e-12))
        chance = raked.select(*DIMENSIONS, (ratio * F.lit(float(total))).alias("weight"), F.least(F.lit(1.0), F.lit(scale) * ratio).alias("probability"))
    joined = rows.alias("r").join(chance.alias("c"), [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in DIMENSIONS], "left")
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(29)), 11) / F.lit(float(2**53))
    # Only cells without tokens have no chance of their own.
    out = joined.select("r.*", *[F.coalesce(F.col(f"c.{c}"), F.lit(1.0)).alias(c) for c in ("weight", "probability")])
    return out.withColumn("sampled", draw < F.col("probability")).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled", *extra)


# -- query ----------------------------------------------------------------------------------------------------


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
