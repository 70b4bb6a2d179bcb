"""Retrieval and classification metrics, and comparisons of systems by question."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
#: Texts that Python holds at once, and those of an Arrow batch.
SLICE, ARROW_TEXTS = 128, "1024"


def containment(docs: DataFrame, items: DataFrame, batch: int = 20_000) -> DataFrame:
    """(query_id, doc_id): documents that hold an item's text word for word.

    Items are collected and broadcast, ``batch`` at a time; one pass of an Aho-Corasick automaton finds all of a batch
    in each document, so documents are neither shuffled nor paired with items.
    """
    own = items.where("text <> ''")
    parts = max(1, -(-own.count() // batch))
    found = [_contained(docs, own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n) if parts > 1 else own) for n in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    few = [(r["query_id"], r["text"]) for r in items.collect()]  # a batch
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default: too many whole texts at once
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_TEXTS)
    sent = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for i, text in sent.value:
            by.setdefault(text, []).append(i)
        for text, ids in by.items():
            found.add_word(text, ids)
        found.make_automaton()
        for batch in batches:
            q, d = [], []
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    hits = sorted({i for _, ids in found.iter(text or "") for i in ids}) if by else []
                    q += hits
                    d += [doc] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64())], names=["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "query_id long, doc_id long")


def by_query(gold: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """A row for each question with a required group: groups, first_rank, hits at each k, dcg, ideal and so on.

    ``gold`` is (query_id, group_id, doc_id, grade 2 or 1, required). Ranks count within required groups' documents;
    graded gain counts all groups.
    """
    top = ranking.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    hits = gold.join(top, ["query_id", "doc_id"], "left")
    groups = hits.groupBy("query_id", "group_id", "required").agg(F.min("rank").alias("rank"))
    need = F.col("required")
    per = groups.groupBy("query_id").agg(
        F.count_if(need).alias("groups"),
        F.min(F.when(need, F.col("rank"))).alias("first_rank"),
        *[F.count_if(need & (F.col("rank") <= n)).alias(f"hit_{n}") for n in KS],
    )
    distinct = hits.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"), F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade")))
    gain = distinct.withColumn("place", place).groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= 5, F.col("grade") / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.sum(F.when(F.col("place") <= 5, F.col("grade") / F.log2(F.col("place") + 1.0))).alias("ideal"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg_binary"),
        F.sum(F.when(F.col("place") <= 5, 1 / F.log2(F.col("place") + 1.0))).alias("ideal_binary"),
    )
    return per.where("groups > 0").join(gain, "query_id").withColumn("full_5", F.col("hit_5") == F.col("groups")).withColumn("full_10", F.col("hit_10") == F.col("groups"))


def metrics(per: DataFrame, *by: str | Column) -> DataFrame:
    """Recall, MRR, graded nDCG, group recall, coverage and full evidence over the rows of ``by_query``, for each value of ``by``."""
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    first = F.col("first_rank")
    return per.groupBy(*by).agg(
        F.count("*").alias("questions"),
        *[share(first <= n).alias(f"recall_{n}") for n in KS],
        F.round(F.avg(F.coalesce(1 / first, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("dcg") / F.col("ideal")), 6).alias("ndcg_5"),
        *[F.round(F.sum(f"hit_{n}") / F.sum("groups"), 6).alias(f"group_recall_{n}") for n in KS],
        F.round(F.avg(F.col("hit_5") / F.col("groups")), 6).alias("coverage_5"),
        share(F.col("full_5")).alias("full_5"),
        share(F.col("full_10")).alias("full_10"),
    )


def outcome(before_full: Column, after_full: Column, before_rank: Column, after_rank: Column) -> Column:
    """win, loss, mixed or tie: full evidence first, then the first gold rank."""
    return (
        F.when(~before_full & after_full, "win")
        .when(before_full & ~after_full, "loss")
        .when(before_full & after_full, F.when(after_rank < before_rank, "win").when(after_rank > before_rank, "loss").otherwise("tie"))
        .when(before_rank.isNull() & after_rank.isNotNull(), "mixed")
        .when(before_rank.isNotNull() & after_rank.isNull(), "loss")
        .otherwise("tie")
    )


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id and outcome; both sides must have the same questions: those that one lacks come out as missing."""
    a = before.select("query_id", F.col("full_5").alias("af"), F.col("first_rank").alias("ar"), F.lit(True).alias("has_a"))
    b = after.select("query_id", F.col("full_5").alias("bf"), F.col("first_rank").alias("br"), F.lit(True).alias("has_b"))
    both = a.join(b, "query_id", "full")
    return both.select("query_id", F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "missing").otherwise(outcome(F.col("af"), F.col("bf"), F.col("ar"), F.col("br"))).alias("outcome"))


def deltas(before: DataFrame, after: DataFrame, miss: int = 11) -> DataFrame:
    """query_id, rank_delta, group_delta, direction: a miss counts as rank ``miss``; opposite directions are mixed."""
    a = before.select("query_id", F.coalesce("first_rank", F.lit(miss)).alias("ar"), F.col("hit_5").alias("ah"))
    b = after.select("query_id", F.coalesce("first_rank", F.lit(miss)).alias("br"), F.col("hit_5").alias("bh"))
    both = a.join(b, "query_id").select("query_id", (F.col("ar") - F.col("br")).cast("long").alias("rank_delta"), (F.col("bh") - F.col("ah")).cast("long").alias("group_delta"))
    up, down = (F.col("rank_delta") > 0) | (F.col("group_delta") > 0), (F.col("rank_delta") < 0) | (F.col("group_delta") < 0)
    return both.withColumn("direction", F.when(up & down, "mixed").when(up, "improved").when(down, "worse").otherwise("same"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def label_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of each label that is gold or predicted; a zero division is 0. One aggregate over pairs."""
    pairs = confusion(rows, gold, predicted)
    each = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("x"), "gold", "predicted", "n")
    hit = F.when((F.col("gold") == F.col("predicted")) & (F.col("x.g") > 0), F.col("n")).otherwise(0)
    sums = each.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum(hit).alias("hits"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    sums = sums.withColumn("precision", div(F.col("hits"), F.col("predicted"))).withColumn("recall", div(F.col("hits"), F.col("support")))
    return sums.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def summary_scores(scores: DataFrame) -> DataFrame:
    """One row: accuracy, and F1 averaged over labels that occur as gold."""
    return scores.agg(F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 6).alias("macro_f1"))


def tfidf_cosine(pairs: DataFrame, corpus: DataFrame, id_: str = "id") -> DataFrame:
    """id, score: cosine of the TF-IDF vectors of ``a`` and ``b`` (token lists) in ``pairs`` (id, a, b).

    Term weight: count / length times idf = ln((1 + N) / (1 + df)) + 1 over the token lists ``t`` in ``corpus``; unseen terms
    have idf 1. Vectors stay rows, so no vocabulary is collected.
    """
    n = corpus.agg(F.count("*").alias("n"))
    df = corpus.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n: one row
    side = lambda c: pairs.select(id_, F.size(c).alias("len"), F.explode(c).alias("term")).groupBy(id_, "term", "len").agg((F.count("*") / F.col("len")).alias(c))
    both = side("a").drop("len").join(side("b").drop("len"), [id_, "term"], "full").join(idf, "term", "left")
    w = F.coalesce("idf", F.lit(1.0))
    x, y = F.coalesce("a", F.lit(0.0)) * w, F.coalesce("b", F.lit(0.0)) * w
    sums = both.groupBy(id_).agg(F.sum(x * y).alias("dot"), F.sqrt(F.sum(x * x)).alias("nx"), F.sqrt(F.sum(y * y)).alias("ny"))
    sums = pairs.select(id_).join(sums, id_, "left")
    return sums.select(id_, F.round(F.coalesce(F.col("dot") / F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0)), F.lit(0.0)), 6).alias("score"))


def verdict(score: Column, sufficient: float, partial: float, empty: Column) -> Column:
    return F.when(empty, "missing").when(score >= sufficient, "sufficient").when(score >= partial, "partial").otherwise("missing")
