"""Small provenance graphs, and components of shared parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.sinks import discard, written


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, id): repeated node or edge ids, and edges whose ends aren't nodes."""
    again = lambda df, c, name: df.groupBy(c).count().where("count > 1").select(F.lit(name).alias("issue"), F.col(c).alias("id"))
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node_id"))
    lost = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.lit("unknown_node").alias("issue"), F.col("edge_id").alias("id")).distinct()
    return again(nodes, "node_id", "repeated_node").unionByName(again(edges, "edge_id", "repeated_edge")).unionByName(lost)


def paths(nodes: DataFrame, edges: DataFrame, queries: DataFrame, hops: int = 2, k: int = 5) -> DataFrame:
    """query_id, nodes, edges, score, rank: simple directed paths of 1 to ``hops`` edges from nodes whose label shares a word with the query.

    ``nodes`` is (node_id, words), ``edges`` (edge_id, src, dst), ``queries`` (query_id, words): words as lists. Score: the query's words among those
    of the path's labels, over the number of nodes. Order: score, then edges, then nodes. The frontier is joined to the
    edges once a hop; a node on the path isn't visited again.
    """
    from pyspark.sql import Window as W

    word = queries.select("query_id", F.col("words").alias("q"), F.explode(F.array_distinct("words")).alias("w"))
    named = nodes.select("node_id", "words", F.explode(F.array_distinct("words")).alias("w"))
    seeds = word.join(named, "w").select("query_id", "q", "node_id", "words").distinct()
    now = seeds.select("query_id", "q", F.array("node_id").alias("nodes"), F.array().cast("array<" + dict(edges.dtypes)["edge_id"] + ">").alias("edges"), F.col("node_id").alias("at"), F.array_distinct("words").alias("seen"))
    target = nodes.select(F.col("node_id").alias("dst"), F.col("words").alias("dst_words"))
    steps = edges.join(target, "dst")
    found = []
    for _ in range(hops):
        now = now.join(steps, F.col("at") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        now = now.select("query_id", "q", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges"), F.col("dst").alias("at"), F.array_union("seen", "dst_words").alias("seen"))
        found.append(now)
    every = reduce(DataFrame.unionByName, found)
    scored = every.select("query_id", "nodes", "edges", F.round(F.size(F.array_intersect("q", "seen")) / F.size("nodes"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "edges", "nodes"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each item's larger neighbours (large) or all but the least of its smaller ones (small) are linked to the least item it sees."""
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    near = seen.join(least, "a")
    if large:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(members: DataFrame, item: str, parent: str, rounds: int = 60) -> DataFrame:
    """``item``, component: the smallest item that shares parents with it, over any chain; an item without a parent is its own.

    A parent's items are linked to its least, then large and small stars alternate: rounds grow with the logarithm of
    a component's size, not with the length of its chains. Each round is a written table in the shared folder and the
    one before is deleted. Null items are left out.
    """
    own = members.where(F.col(item).isNotNull() & F.col(parent).isNotNull()).select(F.col(item).alias("a"), F.col(parent).alias("p"))
    first = own.groupBy("p").agg(F.min("a").alias("b"))
    now, state = written(own.join(first, "p").where("a <> b").select("a", "b").distinct(), "components"), None
    for _ in range(rounds):
        was, now = now, written(_star(_star(now, True), False), "components")
        discard(was)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            every = members.where(F.col(item).isNotNull()).select(item).distinct()
            return every.join(now.select(F.col("a").alias(item), F.col("b").alias("component")), item, "left").select(item, F.coalesce("component", F.col(item)).alias("component"))
        state = seen
    raise RuntimeError(f"components: no end after {rounds} rounds")


def distinct_spans(paths: DataFrame, spans: str) -> DataFrame:
    """The spans of a path without repeats, at their first place."""
    return paths.withColumn(spans, F.array_distinct(spans))
