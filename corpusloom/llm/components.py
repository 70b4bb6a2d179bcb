"""Connected components of a table of links: in one task up to ``FEW`` links, beyond by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, written

ROUNDS = 60
#: Links of two longs that one task takes: 16 MB.
FEW = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or, small, its other) neighbours to the least node that it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    out = both.join(least, "a")
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return out.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches): roots hook to lesser roots, then paths are cut short, until nothing changes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (root != (up := root[root])).any():
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            nodes, roots = labelled(*[np.concatenate(x) for x in zip(*held)])
            for at in range(0, len(nodes), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 65_536]), pa.array(roots[at : at + 65_536])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, tag: str = "components", few: int = FEW) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; nodes without a link aren't listed.

    ``edges`` has columns a and b of one comparable type. Links to itself and repeated links are allowed; a link
    with a null end is none. At most ``few`` links of longs go to one task. Beyond, each round is a written table, so a lost executor costs one round at most. The
    joins are on the node with its least neighbour alone, so a hub's links are split as any skewed join's.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    if dict(now.dtypes)["a"] == "bigint" and now.count() <= few:
        return _in_one_task(now.select("a", "b"))
    state = None
    for _ in range(ROUNDS):
        was, now = now, written(_star(_star(now, True), False), tag)
        discard(was)
        # The links are stars about the least nodes, and stay so, when no node is both an end and a centre.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
    raise RuntimeError(f"components of {tag}: no end after {ROUNDS} rounds")
