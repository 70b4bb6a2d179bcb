"""Stores over tables: conversations, memory, sessions, tools, citations, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.sources.sinks import spread


def recent(messages: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    """The last ``n`` messages of each conversation, with their place in reading order."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    few = messages.withColumn("__back", back).where(F.col("__back") <= n)
    return few.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long")).drop("__back")


def preceding(messages: DataFrame, key: str, order: str, text: str, n: int = 2) -> DataFrame:
    """Adds context: the ``n`` texts before, joined by newlines."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return messages.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def titles(messages: DataFrame, key: str, order: str, most: int = 60) -> DataFrame:
    """key, title, messages, last: the first user message, cut with an ellipsis, with counts."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col(order)))
    by = messages.groupBy(key).agg(first.alias("t"), F.count("*").alias("messages"), F.max(order).alias("last"))
    has = messages.where("role = 'user'").select(key).distinct().withColumn("user", F.lit(True))
    title = F.when(F.col("user"), F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("…"))).otherwise(F.col("t")))
    return by.join(has, key, "left").select(key, title.alias("title"), "messages", "last")


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """A delete that cascades: every table without the keys that go."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def sessions(auth: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't expired, with their users."""
    return auth.where(F.col("expires_at") > now).join(users, "user_id")


def budgeted(calls: DataFrame, trace: str, order: str, budget: int) -> DataFrame:
    """Adds call_no and status: beyond ``budget`` calls of a trace they are refused, errors are mapped."""
    no = F.row_number().over(W.partitionBy(trace).orderBy(order))
    calls = calls.withColumn("call_no", no.cast("long"))
    return calls.withColumn("status", F.when(F.col("call_no") > budget, "budget_exceeded").when(F.col("failed"), "tool_error").otherwise("ok"))


def verify_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """citation_id, status: ok, unknown_evidence, or unknown_span where the evidence lacks the span."""
    both = citations.join(evidence.select("evidence_id", "spans"), "evidence_id", "left")
    status = F.when(F.col("spans").isNull(), "unknown_evidence").when(F.array_contains("spans", F.col("span")), "ok").otherwise("unknown_span")
    return both.select("citation_id", status.alias("status"))


def canonical_citations(citations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """citation_id, canonical_id: of citations that are equal in ``keys`` the first."""
    first = F.first("citation_id").over(W.partitionBy(*keys).orderBy(order, "citation_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return citations.select("citation_id", first.alias("canonical_id"))


def span_matches(evidence: DataFrame, chunks: DataFrame, least: float = 0.5, near: float = 0.75) -> DataFrame:
    """evidence_id, chunk_id, score, primary: chunks of the same page by the share of the evidence's rectangle that they cover.

    The best is primary; others count if they reach max(least, near * best). Both have page, x0, y0, x1, y1.
    """
    e = evidence.select("page", "evidence_id", *[F.col(c).alias(f"e_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = e.join(chunks, "page")
    wide = F.greatest(F.least("e_x1", "x1") - F.greatest("e_x0", "x0"), F.lit(0.0))
    high = F.greatest(F.least("e_y1", "y1") - F.greatest("e_y0", "y0"), F.lit(0.0))
    area = (F.col("e_x1") - F.col("e_x0")) * (F.col("e_y1") - F.col("e_y0"))
    scored = both.withColumn("score", F.round(wide * high / F.nullif(area, F.lit(0.0)), 6)).where("score > 0")
    w = W.partitionBy("evidence_id")
    scored = scored.withColumn("best", F.max("score").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")))
    kept = scored.where((F.col("n") == 1) | (F.col("score") >= F.greatest(F.lit(least), F.col("best") * near)))
    return kept.select("evidence_id", "chunk_id", "score", (F.col("n") == 1).alias("primary"))


def anchors_repaired(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """anchor, block_id: the block of that id, else the one block of the page that starts or ends with it; none if several do.

    Blocks offer their own ends, as long as some anchor is, and anchors look them up: a page's blocks and anchors are
    never paired. What the ends of one page have in common is counted where they arise.
    """
    asked = anchors.select("page", "anchor").distinct()
    own = spread(blocks.select("page", "block_id"), "block_id")
    sizes = asked.agg(F.collect_set(F.length("anchor")).alias("sizes"))  # one row, of distinct lengths
    shorter = F.filter("sizes", lambda n: n < F.length("block_id"))
    ends = F.array_distinct(F.concat(F.transform(shorter, lambda n: F.left("block_id", n)), F.transform(shorter, lambda n: F.right("block_id", n))))
    part = own.join(F.broadcast(sizes)).select("page", "block_id", F.explode(ends).alias("anchor")).groupBy("page", "anchor").agg(F.count("*").alias("n"), F.max("block_id").alias("one"))
    exact = own.select("page", F.col("block_id").alias("anchor"), F.lit(True).alias("exact")).distinct()
    both = asked.join(exact, ["page", "anchor"], "left").join(part, ["page", "anchor"], "left")
    return both.select("page", "anchor", F.when(F.col("exact"), F.col("anchor")).when(F.col("n") == 1, F.col("one")).alias("block_id"))


def referential(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, issue: str) -> DataFrame:
    """(issue, id): keys of ``child`` that ``parent`` lacks."""
    lost = child.select(F.col(child_key).alias("id")).where("id is not null").distinct().join(parent.select(F.col(parent_key).alias("id")), "id", "left_anti")
    return lost.select(F.lit(issue).alias("issue"), F.col("id").cast("string").alias("id"))


def repeated(rows: DataFrame, key: str, issue: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(F.lit(issue).alias("issue"), F.col(key).cast("string").alias("id"))


def checks(values: dict[str, Column], rows: DataFrame) -> DataFrame:
    """A row for each named check, from one aggregate of ``rows``."""
    one = rows.agg(*[v.alias(k) for k, v in values.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k), F.lit(False)).alias("passed")) for k in values])).alias("x")).select("x.check", "x.passed")
