"""BM25 over a table of documents, for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.sources.sinks import discard, files_released, spread, written

K1, B = 1.5, 0.75
#: Queries' terms that are broadcast.
FEW_TERMS = 100_000
#: (query, document, term) rows that one task sums.
ROWS_A_PART = 2_000_000
#: Number of the term that stands for the document itself.
EVERY = -1


def query_terms(queries: DataFrame, id_: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term): a query is a set of terms."""
    return queries.select(F.col(id_).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def lengths(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("n_tokens"))


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, n_tokens): the index as a table, to be written and read again.

    Where no two rows have one id, a document's terms are counted as runs of its own sorted tokens and nothing is shuffled.
    """
    own = docs.select(F.col(id_).alias("doc_id"), tokens(F.col(text)).alias("t"))
    if docs.groupBy(id_).count().where("count > 1").isEmpty():
        own = spread(docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("t")), "doc_id").select("doc_id", F.sort_array(tokens(F.col("t"))).alias("t")).where(F.size("t") > 0)
        n = F.size("t")
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
        own = own.select("doc_id", "t", n.cast("long").alias("n_tokens"), starts.alias("starts"))
        ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(n))
        runs = F.zip_with("starts", ends, lambda i, j: F.struct(F.get("t", i).alias("term"), (j - i).cast("long").alias("tf")))
        return own.select("doc_id", "n_tokens", F.inline(runs))
    own = own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.explode("t").alias("term"))
    return own.groupBy("doc_id", "n_tokens", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, keep: Column | None = None, id_: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best documents of each query.

    ``queries`` has query_id and text. Document frequencies, the number of documents and their mean length are those
    of all ``docs``; ``keep`` only says which may be returned. Documents without a query term aren't ranked. Scores
    are rounded to six digits before they are ranked; ties go to the smaller id.

    Texts are tokenised once, and only tokens that some query has leave the scan: what is shuffled and written to the
    shared folder is matches (with one row a document that holds its length), not the corpus. Terms are numbered, and the
    (query, document, term) rows are dealt so that a task has about ``ROWS_A_PART`` of them. The ranking is a written table.
    """
    if k <= 0 or k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k and k1 are positive, b is from 0 to 1")
    with files_released(docs.sparkSession):
        return _bm25(docs, queries, k, keep, id_, text, k1, b)


def _bm25(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None, id_: str, text: str, k1: float, b: float) -> DataFrame:
    every = F.lit("")  # no token is empty: it stands for the document itself
    asked = written(query_terms(queries), "bm25-queries")
    wanted = asked.groupBy("term").agg(F.count("*").alias("queries")).withColumn("no", F.monotonically_increasing_id())
    wanted = written(wanted.unionByName(docs.sparkSession.createDataFrame([("", 0, EVERY)], "term string, queries long, no long")), "bm25-terms")
    few = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted
    terms = asked.join(few, "term").select("query_id", "no")
    flag = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    own = spread(docs.select(F.col(id_).alias("doc_id"), flag.alias("keep"), F.col(text).alias("text")), "doc_id")
    own = own.select("doc_id", "keep", F.array_append(tokens(F.col("text")), every).alias("t"))
    # explode_outer: else Spark would tokenise once more to look for empty lists.
    found = own.select("doc_id", "keep", (F.size("t") - 1).alias("n_tokens"), F.explode_outer("t").alias("term")).join(few, "term")
    matches = written(found.groupBy("no", "doc_id", "keep", "n_tokens").agg(F.count("*").alias("tf")), "bm25-matches")
    stats = matches.where(F.col("no") == EVERY).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("n_tokens")) / F.sum("tf")).alias("mean"))
    tf = matches.where(F.col("no") != EVERY)
    df = tf.groupBy("no").agg(F.sum(F.lit(1)).alias("df"))
    n = F.col("n_docs")
    idf = df.join(F.broadcast(stats)).select("no", "df", "mean", F.log(F.lit(1.0) + (n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))  # stats: one row
    idf = written(idf, "bm25-idf")
    rows = idf.join(wanted, "no").agg(F.coalesce(F.sum(F.col("df") * F.col("queries")), F.lit(0))).first()[0]
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean")))
    # Dealt by document before terms meet queries: the many (query, document, term) rows are summed where they arise.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // ROWS_A_PART))
    scored = tf.where("keep").join(idf, "no").select("no", "doc_id", weight.alias("w")).repartition(parts, "doc_id").join(terms, "no")
    scored = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    best = written(top_k(scored, k), "bm25-ranking")
    for x in (asked, wanted, matches, idf):
        discard(x)
    return best


def top_k(scored: DataFrame, k: int, by: str = "query_id", id_: str = "doc_id") -> DataFrame:
    """Ranks from 1 by score, ties to the smaller id, down to ``k``."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), id_))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
