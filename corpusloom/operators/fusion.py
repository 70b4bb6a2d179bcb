"""Operators from rankings to rankings. A ranking is a table (query_id, doc_id, score, rank), ranks from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import coverage, tokens
from corpusloom.operators.lexical import top_k
from corpusloom.operators.scan import running_sums
from corpusloom.sources.sinks import written

RRF_K = 60


def _stacked(lists: list[DataFrame]) -> DataFrame:
    """All rankings in one table, with the list's number as ``list_no``."""
    return reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "score", "rank").withColumn("list_no", F.lit(n)) for n, x in enumerate(lists)])


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = RRF_K, positional: bool = False) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists that hold a document; ties to the smaller id.

    ``positional`` ranks by place in the list instead of the stored rank. ``first_list`` is the first list that has the
    document: whose payload stays.
    """
    rows = _stacked(lists)
    if positional:
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list_no").orderBy("rank", "doc_id")))
    fused = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + constant)), 6).alias("score"), F.min("list_no").cast("long").alias("first_list"))
    return top_k(fused, k)


def round_robin(lists: list[DataFrame], k: int) -> DataFrame:
    """Each list's row at depth 1, then at depth 2 and so on, each document once; ranks from 1 to ``k``."""
    rows = _stacked(lists)
    order = F.row_number().over(W.partitionBy("query_id").orderBy("depth", "list_no"))
    rows = rows.withColumnRenamed("rank", "depth").withColumn("n", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("depth", "list_no"))).where("n = 1").drop("n")
    return rows.withColumn("rank", order.cast("long")).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", F.col("list_no").cast("long").alias("list_no"))


def merge_best(original: DataFrame, more: DataFrame) -> DataFrame:
    """One row for each document, of the larger score; the original wins ties."""
    rows = _stacked([original, more])
    n = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "list_no"))
    return rows.withColumn("n", n).where("n = 1").select("query_id", "doc_id", "score", F.col("list_no").cast("long").alias("list_no"))


def merge_last(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row for each document, of the second table where both have it."""
    rows = _stacked([first, second])
    n = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("list_no"), "rank"))
    return rows.withColumn("n", n).where("n = 1").select("query_id", "doc_id", "score", F.col("list_no").cast("long").alias("list_no"))


def new_evidence(found: DataFrame, original: DataFrame) -> DataFrame:
    """What was found beyond the original documents, each at its first place."""
    n = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank"))
    fresh = found.join(original.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return fresh.withColumn("n", n).where("n = 1").drop("n")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer=None) -> DataFrame:
    """Candidates by ``scorer(query text, document text)`` (a column); the default is the share of query tokens that the document has.

    Candidates' texts alone are joined. Ties to the smaller id.
    """
    scorer = scorer or (lambda q, d: F.round(coverage(tokens(q), tokens(d)), 6))
    pairs = candidates.select("query_id", "doc_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    pairs = docs.select("doc_id", F.col("text").alias("d")).join(pairs, "doc_id")
    return top_k(pairs.select("query_id", "doc_id", scorer(F.col("q"), F.col("d")).alias("score")), k)


def expand_to_parents(children: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """query_id, parent_id, score, rank: ranked children (query_id, child_id, score, rank) to their parents (child_id, parent_id).

    A parent has its first child's score and place. Children without a parent aren't kept: ``missing_parents`` finds them.
    """
    joined = children.join(parents, "child_id")
    first = F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy("rank"))
    joined = joined.withColumn("n", first).where("n = 1")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return joined.withColumn("place", order.cast("long")).where(F.col("place") <= k).select("query_id", "parent_id", "score", F.col("place").alias("rank"))


def missing_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    return children.join(parents, "child_id", "left_anti")


def gate(rankings: DataFrame, queries: DataFrame, sufficient: float, related: float, rewritten: bool = False) -> DataFrame:
    """query_id, best, decision: generate, rewrite, refuse_insufficient or refuse_out_of_domain."""
    best = rankings.groupBy("query_id").agg(F.max("score").alias("best"))
    best = queries.select("query_id").join(best, "query_id", "left")
    again = "refuse_insufficient" if rewritten else "rewrite"
    decision = F.when(F.col("best") >= sufficient, "generate").when(F.col("best") >= related, again).otherwise("refuse_out_of_domain")
    return best.select("query_id", "best", decision.alias("decision"))


def calibrate(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row, (threshold, balanced): the score at which accuracy balanced over the two labels is largest; ties to the higher.

    Rows at or above a threshold count as positive, NaN is above all numbers. Rows without a score are positive at no
    threshold but count among their label's; where there are any, a null threshold (none is positive) competes, after
    all others. Counts are summed by score first, so the running sums see each distinct score once.
    """
    kind = F.col(label).cast("int")
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(kind == 1).alias("p"), F.count_if(kind == 0).alias("n"))
    by = written(by, "scores")
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    none = by.where("threshold is null").select("threshold", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    by = running_sums(by.where("threshold is not null"), "threshold", {"tp": "p", "fp": "n"}, descending=True).select("threshold", "tp", "fp").unionByName(none)
    by = by.join(F.broadcast(total))  # one row
    rate = (F.coalesce(F.col("tp") / F.nullif("all_p", F.lit(0)), F.lit(0.0)) + 1 - F.coalesce(F.col("fp") / F.nullif("all_n", F.lit(0)), F.lit(0.0))) / 2
    return by.select("threshold", F.round(rate, 6).alias("balanced")).orderBy(F.desc("balanced"), F.desc_nulls_last("threshold")).limit(1)


def support_gated(base: DataFrame, targeted: DataFrame, k: int, margin: float = 0.0, most: int = 2, seen: int = 5) -> DataFrame:
    """query_id, doc_id, rank, inserted: the base ranking with up to ``most`` documents of targeted queries in its last places.

    ``targeted`` is (query_id, target_no, doc_id, score, place): scored rows of each targeted query, among them
    base documents of the first ``seen`` places. The best new one of a target is taken if it scores above the target's
    best base document plus ``margin``. No document is taken twice; no new evidence leaves the base as it is.
    """
    top = base.where(F.col("rank") <= seen).select("query_id", "doc_id", F.lit(True).alias("known"))
    every = base.select("query_id", "doc_id", F.lit(True).alias("ranked"))
    rows = targeted.join(top, ["query_id", "doc_id"], "left").join(every, ["query_id", "doc_id"], "left")
    old = rows.where("known").groupBy("query_id", "target_no").agg(F.max("score").alias("old"))
    new = rows.where("ranked is null").withColumn("n", F.row_number().over(W.partitionBy("query_id", "target_no").orderBy(F.desc("score"), "place", "doc_id"))).where("n = 1")
    taken = new.join(old, ["query_id", "target_no"]).where(F.col("score") > F.col("old") + margin)
    taken = taken.groupBy("query_id", "doc_id").agg(F.min("target_no").alias("target_no"))
    taken = taken.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("target_no", "doc_id"))).where(F.col("n") <= most)
    count = taken.groupBy("query_id").agg(F.max("n").alias("taken"))
    kept = base.join(count, "query_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).where(F.col("rank") <= k - F.col("taken"))
    placed = taken.join(kept.groupBy("query_id").agg(F.count("*").alias("kept")), "query_id", "left")
    last = placed.select("query_id", "doc_id", (F.coalesce("kept", F.lit(0)) + F.col("n")).cast("long").alias("rank"), F.lit(True).alias("inserted"))
    return kept.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(False).alias("inserted")).unionByName(last)


def adjacent(seeds: DataFrame, order: DataFrame, queries: DataFrame, seen: int = 5) -> DataFrame:
    """query_id, doc_id, seed_id, score: documents one place beside a seed in its group that aren't seeds themselves.

    ``order`` is (doc_id, grp, pos, text). Score: 1 / (60 + seed's rank) + the share of the query's tokens; of a document's
    seeds the best stays, the first on a tie.
    """
    top = seeds.where(F.col("rank") <= seen)
    at = top.join(order.select("doc_id", "grp", "pos"), "doc_id").select("query_id", F.col("doc_id").alias("seed_id"), "rank", "grp", F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos"))
    near = at.join(order, ["grp", "pos"]).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    near = near.join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    score: Column = F.round(F.lit(1.0) / (F.col("rank") + RRF_K) + coverage(tokens(F.col("q")), tokens(F.col("text"))), 6)
    near = near.select("query_id", "doc_id", "seed_id", "rank", score.alias("score"))
    n = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "rank"))
    return near.withColumn("n", n).where("n = 1").select("query_id", "doc_id", "seed_id", "score")
