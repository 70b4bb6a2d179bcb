"""SimHash near-dedup with anchor points of a covering code.

A fingerprint of 64 bits has two blocks of 31 bits (two bits are in neither). Fingerprints that differ in at most
``3`` bits differ in at most one bit in one of the blocks. The anchors of a block are the words of the perfect
Hamming code of length 31: its covering radius is 1, so each block is within 1 of exactly one anchor, its home.
A fingerprint is replicated to every anchor within covering radius plus block threshold, 1 + 1 = 2 (16 at most),
so it meets each partner at the partner's home, and all are compared per anchor over the full 64 bits.

Only distinct fingerprints are replicated. Anchors of more than ``HOT_ROWS`` fingerprints are split further: two
linked fingerprints agree in one of four 16-bit parts, so the anchor's rows are dealt by each part's value.
An anchor gives a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, only, table, written
from corpusloom.llm.components import components

BITS = 64
THRESHOLD = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCK = 31
BLOCK_THRESHOLD = THRESHOLD // 2
HOT_ROWS = 20_000
SMALL_GROUP = 24

# -- fingerprints ---------------------------------------------------------------------------------------------


def simhash(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles' XXH64 hashes. No words: 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, ASCII space alone splits
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], seed) for i, j in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) and the columns in ``carry``. Null text: as no words."""
    from pyspark.sql import types as T

    own = only(docs, "doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    kinds = {f.name: f.dataType for f in own.schema}

    def make():
        def f(batch):
            return {c: batch.column(c) for c in ("doc_id", *carry)} | {"fp": pa.array(np.array([simhash(t or "") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64))}

        return f

    return arrow_map(own, T.StructType([T.StructField("doc_id", kinds["doc_id"]), *[T.StructField(c, kinds[c]) for c in carry], T.StructField("fp", T.LongType())]), make, 256)


# -- anchors --------------------------------------------------------------------------------------------------

#: Positions 1 to 31 whose number has bit k, as masks: the rows of the Hamming code's parity check.
_CHECKS = [sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> k & 1) for k in range(5)]


def _syndrome(words: np.ndarray) -> np.ndarray:
    return sum(((np.bitwise_count(words & np.uint64(m)) & 1).astype(np.int64) << k for k, m in enumerate(_CHECKS)), np.zeros(len(words), np.int64))


def _flips() -> np.ndarray:
    """For each syndrome, the bits to flip to get each code word within 2: one of one bit (the home), 15 of two bits."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        out[s] = [1 << (s - 1), *[1 << (i - 1) | 1 << (j - 1) for i, j in pairs]]
    return out


_FLIPS = _flips()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place in ``fps``, is home) of every replica."""
    found = []
    place = np.arange(len(fps))
    for block in range(2):
        words = (fps >> np.uint64(block * BLOCK)) & np.uint64((1 << BLOCK) - 1)
        s = _syndrome(words)
        near = words[:, None] ^ _FLIPS[s]
        keep = np.ones(near.shape, bool)
        keep[s == 0, 1:] = False  # a code word has no other within 2
        home = np.zeros(near.shape, bool)
        home[:, 0] = True
        found.append(((near[keep] | np.uint64(block << BLOCK)).view(np.int64), np.broadcast_to(place[:, None], near.shape)[keep], home[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _replicas(fps: DataFrame) -> DataFrame:
    def make():
        def f(batch):
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            key, place, home = anchors(own.view(np.uint64))
            return {"anchor": pa.array(key), "fp": pa.array(own[place]), "home": pa.array(home)}

        return f

    return arrow_map(fps, "anchor long, fp long, home boolean", make, 10_000)


def group_links(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within one group of distinct fingerprints, by breadth-first search over those left."""
    a, b, left = [], [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ (x := front.pop())) <= threshold
            if near.any():
                a.append(np.full(int(near.sum()), x))
                b.append(left[near])
                front += list(b[-1])
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _sorted_links(key: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: neighbours at each distance in small groups, a search in large ones."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    small = np.repeat(size <= SMALL_GROUP, size)
    k, x, h = key[small], fps[small], home[small]
    rest = np.repeat(size, size)[small] - (np.arange(len(key)) - np.repeat(starts, size))[small]  # rows of the group from here on
    at = np.arange(len(k))
    for d in range(1, SMALL_GROUP):
        at = at[rest[at] > d]
        if not len(at):
            break
        hit = at[(np.bitwise_count(x[at] ^ x[at + d]) <= threshold) & (h[at] | h[at + d])]
        a.append(x[hit])
        b.append(x[hit + d])
    for i in np.flatnonzero(size > SMALL_GROUP):
        if home[s := slice(starts[i], starts[i] + size[i])].any():
            for out, made in zip((a, b), group_links(np.unique(fps[s]), threshold)):
                out.append(made)
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(fps: DataFrame, threshold: int = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): links that span the groups of the distinct fingerprints ``fp`` within ``threshold`` (3 at most) bits."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover up to 3 differing bits")
    hot = written(_replicas(fps).groupBy("anchor").count().where(F.col("count") > hot_rows).select("anchor", F.lit(True).alias("hot")), "simhash-hot")
    rows = _replicas(fps)
    part = lambda j: F.shiftrightunsigned(F.col("fp"), 16 * j).bitwiseAND(F.lit(0xFFFF)) + F.lit(j << 16)
    if hot.limit(1).count():
        rows = rows.join(hot, "anchor", "left").withColumn("part", F.explode(F.when(F.col("hot"), F.array(*[part(j) for j in range(4)])).otherwise(F.array(F.lit(-1).cast("long")))))
    else:
        rows = rows.withColumn("part", F.lit(-1).cast("long"))
    rows = rows.select("anchor", "part", "fp", "home").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def made(cols):
            if not len(cols[0]):
                return
            change = np.concatenate([[False], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            a, b = _sorted_links(np.cumsum(change), cols[2], cols[3], threshold)
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)]
            cols = [np.concatenate(x) for x in zip(held, new)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # the last group may go on
            held = [c[same] for c in cols]
            yield from made([c[~same] for c in cols])
        yield from made(held)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, carry: tuple[str, ...] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of ``threshold`` bits or fewer) and ``carry``.

    Texts without words have fingerprint zero and link like any other. Null text: no words. Null doc_id: such a row
    links like any other but is never the smallest, unless its component has no other id (then component_id is
    null). Repeated rows: each gives a row. Other columns are ignored. No rows: no rows.
    """
    prints = written(fingerprints(docs, carry), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), threshold, hot_rows), "simhash-links")
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(distinct["fp"], "least", F.coalesce("root", distinct["fp"]).alias("root"))
    of = written(of, "simhash-roots")
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", *carry, "fp", "component_id")


# -- query ----------------------------------------------------------------------------------------------------


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
