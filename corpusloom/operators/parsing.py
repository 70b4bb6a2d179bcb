"""A document's heading tree from its blocks, and checks of structures that a model proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.structure import heading_level, section_paths

# Titles that begin and end zones outside the text.
CONTENTS = r"^(?i:mục lục|contents|table of contents)$"
BACK = r"^(?i:tài liệu tham khảo|phụ lục|danh mục tài liệu|references|appendix)"
REVIEW = r"^(?i:(nội dung|câu hỏi) (ôn tập|thảo luận)|bài tập|review questions|exercises)"
CONCLUSION = r"^(?i:kết luận|tổng kết|tổng kết chương|phần kết|conclusion)$"
TAIL_PAGES, TAIL_SHARE = 3, 0.1
JOIN_POINTS = 12.0


def parse_structure(blocks: DataFrame) -> DataFrame:
    """Adds level, excluded, chapter, section, subsection, parent_line, absorbed to a document's body blocks.

    ``blocks`` is (doc_id, page, line_no, text, role, bold, scanned, y), line_no in reading order. In turn: body blocks
    alone; headings count from the first chapter on; pages at the end (the last tenth, three at least) with two or
    more chapter headings are a table of contents, whose chapters are none. Contents and back matter exclude what
    follows up to the next chapter; review titles too, or up to a conclusion, and end sections. A chapter takes in
    a short upper-case line that follows on its page, a scanned heading a lower-case line within 12 points.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = blocks.where("role = 'body'").withColumn("text", F.trim(F.regexp_replace("text", "[ \t]+", " ")))
    rows = rows.withColumn("level", heading_level(F.col("text"), F.col("bold"), F.col("scanned")))
    rows = _merged(rows, w)
    pages = blocks.groupBy("doc_id").agg(F.max("page").alias("last"), F.countDistinct("page").alias("pages"))
    tail = F.col("last") - F.greatest(F.lit(TAIL_PAGES), F.ceil(F.col("pages") * TAIL_SHARE))
    crowded = rows.where("level = 1").groupBy("doc_id", "page").count().where("count >= 2").join(pages, "doc_id").where(F.col("page") > tail)
    crowded = crowded.groupBy("doc_id").agg(F.min("page").alias("from_page"))
    rows = rows.join(crowded, "doc_id", "left").withColumn("in_tail", F.coalesce(F.col("page") >= F.col("from_page"), F.lit(False))).drop("from_page")
    rows = rows.withColumn("level", F.when(~F.col("in_tail"), F.col("level")))
    title = F.col("text")
    opens = F.when(F.col("level") == 1, "open").when(title.rlike(CONTENTS) | title.rlike(BACK), "closed").when(title.rlike(REVIEW), "review")
    rows = rows.withColumn("state", F.last(opens, ignorenulls=True).over(run)).withColumn("since", F.max(F.when(opens.isNotNull(), F.col("line_no"))).over(run))
    ended = F.max(F.when(title.rlike(CONCLUSION), F.col("line_no"))).over(run) > F.col("since")
    rows = rows.withColumn("excluded", F.col("in_tail") | (F.col("state") == "closed") | ((F.col("state") == "review") & ~F.coalesce(ended, F.lit(False))))
    rows = rows.withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    started = F.max(F.when(F.col("level") == 1, 1)).over(run).isNotNull()
    rows = rows.withColumn("level", F.when(started & ~F.col("excluded"), F.col("level")))
    return section_paths(rows).drop("state", "since", "in_tail")


def _merged(rows: DataFrame, w: W) -> DataFrame:
    """Headings with the line that they take in; that line goes."""
    nxt = lambda c: F.lead(c).over(w)
    same, free = nxt("page") == F.col("page"), nxt("level").isNull() & nxt("text").isNotNull()
    short = (F.length(nxt("text")) <= 120) & (F.upper(nxt("text")) == nxt("text")) & nxt("text").rlike(r"\p{L}")
    low = F.col("scanned") & (F.abs(nxt("y") - F.col("y")) <= JOIN_POINTS) & nxt("text").rlike(r"^\p{Ll}")
    takes = F.coalesce(same & free & F.when(F.col("level") == 1, short | low).when(F.col("level") > 1, low), F.lit(False))
    rows = rows.withColumn("absorbed", takes).withColumn("__next", nxt("text"))
    rows = rows.withColumn("__gone", F.coalesce(F.lag("absorbed").over(w), F.lit(False))).where("not __gone")
    return rows.withColumn("text", F.when(F.col("absorbed"), F.concat_ws(" ", "text", "__next")).otherwise(F.col("text"))).drop("__next", "__gone")


def substantive(chapter: Column, section: Column, subsection: Column) -> Column:
    """A chunk of a chapter whose labels don't name objectives or reviews."""
    label = lambda c: F.coalesce(F.lower(c), F.lit(""))
    dull = r"(mục tiêu|mục đích|yêu cầu|câu hỏi|ôn tập|objective|review)"
    return chapter.isNotNull() & ~label(section).rlike(dull) & ~label(subsection).rlike(dull)


def split_scanned_blocks(blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, role, text): scanned pages get a block for each line, under new ids; others stay. ``lines`` is an array of texts."""
    each = blocks.where("scanned").select("page_id", "block_id", "role", F.posexplode("lines").alias("n", "text"))
    each = each.select("page_id", F.concat_ws("_l", "block_id", F.col("n").cast("string")).alias("block_id"), "role", "text")
    return each.unionByName(blocks.where("not scanned").select("page_id", "block_id", "role", F.array_join("lines", "\n").alias("text")))


def anchor_issues(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, element_no, issue): anchors that aren't blocks of the page, that an element before used, or that go back in reading order.

    ``elements`` is (page, element_no, block_id), ``blocks`` (page, block_id, pos).
    """
    w = W.partitionBy("page").orderBy("element_no")
    at = elements.join(blocks, ["page", "block_id"], "left")
    at = at.withColumn("furthest", F.max("pos").over(w.rowsBetween(W.unboundedPreceding, -1)))
    at = at.withColumn("use", F.when(F.col("pos").isNotNull(), F.row_number().over(W.partitionBy("page", "block_id").orderBy("element_no"))))
    issue = F.when(F.col("pos").isNull(), "unknown_block").when(F.col("use") > 1, "used_again").when(F.col("pos") < F.col("furthest"), "out_of_order")
    return at.select("page", "element_no", issue.alias("issue")).where("issue is not null")


def batch_issues(wanted: DataFrame, answered: DataFrame, corrections: DataFrame) -> DataFrame:
    """(issue, page): pages of a batch that weren't answered, that weren't asked, answered or corrected twice, or corrected without an answer."""
    name = lambda df, issue: df.select(F.lit(issue).alias("issue"), "page")
    twice = lambda df: df.groupBy("page").count().where("count > 1")
    return (
        name(wanted.join(answered, "page", "left_anti"), "missing_page")
        .unionByName(name(answered.join(wanted, "page", "left_anti"), "unknown_page"))
        .unionByName(name(twice(answered), "repeated_page"))
        .unionByName(name(twice(corrections), "repeated_correction"))
        .unionByName(name(corrections.join(answered, "page", "left_anti").distinct(), "correction_without_page"))
    )


def memory_checks(entries: DataFrame, account: str) -> DataFrame:
    """(check, passed): an account's memory is its own, never evidence, without repeated ids, dated, and not empty text."""
    from corpusloom.operators.stores import checks

    mine = entries.where(F.col("account_id") == account)
    return checks(
        {
            "isolated": F.count_if(F.col("account_id") != account) == 0,
            "never_evidence": F.count_if(F.coalesce("evidence_eligible", F.lit(False))) == 0,
            "unique": F.count("*") == F.countDistinct("memory_id"),
            "dated": F.count_if(F.col("created_at").isNull()) == 0,
            "not_empty": F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "") == 0,
        },
        mine,
    )
