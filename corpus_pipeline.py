"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage takes what the one before kept and, but for the last, returns the columns of documents: doc_id, text,
lang, source, n_chars. Stages are lazy where they can be; ``run`` chains them, and a caller may write and reread
between them. Null texts are empty texts to every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, mixing, near_copies, packing, quality
from corpusloom.llm.common import few, only, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; word vectors from all documents, labels outside its held-out fold.

    A score of 0.5 stays. Null doc_id: scored, never a label. Repeated rows: they stay or go together. Null and empty
    texts: scored as texts without words. No rows: no rows.
    """
    scored = quality.scored(docs, table(spark, sf_dir, "labels"), carry=REST)
    return only(scored.where(F.col("score") >= 0.5), *COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that five documents or more share, but for the largest doc_id's; n_chars is counted anew.

    No document goes; a text of shared lines alone becomes empty, a null text stays as the empty text. Every row is a
    document, so repeated rows count each; those of the largest doc_id keep a line together. Null doc_id: the
    smallest. No rows: no rows.
    """
    kept = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return only(kept.withColumn("n_chars", F.length("text").cast("long")), *COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, Jaccard 0.8 or more): that of the smallest doc_id, null the largest.

    Groups are of texts, so rows of one doc_id and unlike texts are two groups; of rows of one group and doc_id
    the text that hashes lowest stays, of repeated rows one. Texts without words, null among them, are one group. No rows: no rows.
    """
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    found = near_copies.near_copies(docs)
    rooted = only(docs, *COLUMNS).withColumn("node", node).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(rooted.select("doc_id", "node", "root"), "pipeline-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    seen = ids.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if seen["rows"] == seen["ids"]:
        # Every row has an id of its own: only ids meet the texts, those that go, and where they are few enough they are broadcast.
        least = ids.groupBy("root").agg(F.min("doc_id").alias("doc_id"))
        gone = written(ids.select("doc_id").join(least.select("doc_id"), "doc_id", "left_anti"), "pipeline-gone")
        return only(docs.join(few(gone), "doc_id", "left_anti"), *COLUMNS)
    least = ids.groupBy("root").agg(F.min(rank).alias("least"))
    whole = rooted.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node")))
    return only(whole.dropDuplicates(["root"]), *COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn when sources, languages and topics are raked to tempered shares and half of all tokens is kept.

    Repeated rows are drawn together, rows without a doc_id as one id. Null source or language: a value of its own.
    Documents without words stay unless others of their cell have some. No rows: no rows.
    """
    return only(mixing.mixed(docs, carry=("text", "n_chars")).where("sampled"), *COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row for each piece of each row's text.

    Null or empty text: the end token alone. Null doc_id and repeated rows are packed as any; which of equally long
    pieces goes where follows a hash. No rows: no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, XXH64, the topics and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), *COLUMNS)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{n}")
    return docs
