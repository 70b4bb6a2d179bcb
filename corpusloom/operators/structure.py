"""From pages and lines to roles, headings, sections and chunks.

Lines are rows (doc_id, line_no, text, ...). What must be decided line after line within one document - packing with
overlap - runs on the document's row, so nothing is shuffled for it; everything else is windows and expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, stable_id, token_count

TARGET, OVERLAP, PARENT = 400, 50, 1500
#: Documents that Python holds at once.
SLICE = 128

# -- lines ----------------------------------------------------------------------------------------------------


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line_no (from 0), text and the columns in ``keep``: each document's lines."""
    return docs.select("doc_id", *keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def line_weight(text: Column) -> Column:
    return F.greatest(token_count(text), F.lit(1).cast("long"))


BLOCK_TAGS = "h1|h2|h3|h4|h5|h6|p|li|div|nav|footer|article|td|tr|table|ul|ol|br|title|body|header|section"


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, text of a page's blocks: scripts, styles, comments and head go, block tags cut, other tags go."""
    x = F.regexp_replace("html", r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, rf"</?({BLOCK_TAGS})( [^>]*)?/?>", "\x1e")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))
    blocks = F.filter(F.transform(F.split(x, "\x1e", -1), lambda b: F.trim(b)), lambda b: b != "")
    return pages.select("page_id", F.posexplode(blocks).alias("block_no", "text")).withColumn("block_no", F.col("block_no").cast("long"))


def marginal_roles(rows: DataFrame, group: str, top: float = 0.15, bottom: float = 0.85, ratio: float = 0.8) -> DataFrame:
    """Adds role: page_number, header, footer or body.

    ``rows`` has ``group`` (the document), page_id, y (the place on the page from 0 to 1) and text. A margin text counts as
    repeated if it stands on ceil(ratio * pages) distinct pages in that zone. Counts are aggregated, not windowed.
    """
    zone = F.when(F.col("y") <= top, "header").when(F.col("y") >= bottom, "footer")
    rows = rows.withColumn("zone", zone).withColumn("norm", folded(F.col("text")))
    pages = rows.groupBy(group).agg(F.countDistinct("page_id").alias("pages"))
    seen = rows.where("zone is not null").groupBy(group, "zone", "norm").agg(F.countDistinct("page_id").alias("seen")).join(pages, group)
    repeated = seen.where(F.col("seen") >= F.ceil(F.col("pages") * F.lit(ratio))).select(group, "zone", "norm", F.lit(True).alias("repeated"))
    number = F.col("zone").isNotNull() & F.trim("text").rlike(r"^([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,4})$")
    role = F.when(number, "page_number").when(F.col("repeated"), F.col("zone")).otherwise("body")
    return rows.join(repeated, [group, "zone", "norm"], "left").withColumn("role", role).drop("zone", "norm", "repeated")


def repeated_lines(rows: DataFrame, group: str, page: str, ratio: float, most: int = 20) -> DataFrame:
    """``group``, text, pages: lines of 4 to 199 signs on a share of at least ``ratio`` of the group's pages, the ``most`` commonest."""
    total = rows.groupBy(group).agg(F.countDistinct(page).alias("n"))
    text = F.trim("text")
    seen = rows.select(group, page, text.alias("text")).where(F.length("text").between(4, 199)).groupBy(group, "text").agg(F.countDistinct(page).alias("pages"))
    kept = seen.join(total, group).where(F.col("pages") / F.col("n") >= ratio)
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("pages"), "text"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select(group, "text", "pages", "rank")


# -- headings and sections ------------------------------------------------------------------------------------

# What starts a heading.
CHAPTER = r"^(?i:chương|chapter) +([0-9]+|nhập môn)([^0-9A-Za-z].*)?$"
ROMAN_DASH = r"^[IVXLCDM]+ *[-–] +[^ ]"
ROMAN_DOT = r"^[IVXLCDM]+\. +[^ ]"
LETTER_DOT = r"^[A-ZĐ]\. +[A-ZÀ-Ỹ]"
NUMBERED = r"^[1-9](\.[0-9]+)*\. +[^ ]"
LETTER_PAREN = r"^[a-zđ]\) +[^ ]"
BULLET = r"^\* +[^ ]"


def heading_level(text: Column, bold: Column, scanned: Column) -> Column:
    """1 to 5, or null for body text; the first rule that fits.

    Chapters; then roman and lettered divisions; numbered sections, if bold or a scanned line without a sentence's end;
    lettered items; bold bullets. Each has a longest length.
    """
    t = F.trim(F.regexp_replace(text, "[ \t]+", " "))
    n, upper = F.length(t), F.upper(t) == t
    candidate = scanned & (n <= 160) & ~t.rlike(r"[.,;:!?]$")
    rest = F.coalesce(F.regexp_extract(t, CHAPTER, 2), F.lit(""))
    return (
        F.when((n == 0) | (n > 180), None)
        .when(t.rlike(CHAPTER) & (F.upper(rest) == rest), 1)
        .when(t.rlike(ROMAN_DASH), 2)
        .when(t.rlike(ROMAN_DOT) & (upper | candidate), 2)
        .when(t.rlike(LETTER_DOT) & upper, 2)
        .when(t.rlike(NUMBERED) & (bold | candidate) & (n <= 160), 3)
        .when(t.rlike(LETTER_PAREN) & (n <= 120) & (bold | ~scanned | candidate), 4)
        .when(t.rlike(BULLET) & bold & (n <= 100), 5)
        .cast("long")
    )


def section_paths(rows: DataFrame, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds chapter, section, subsection, parent_line from level and text: a heading of one level resets those below it.

    Levels 2 and 3 both set the section. parent_line is the nearest heading before of a lower level. Lines before the
    first chapter have none of these. Heading lines take the path of the next body line, where there is one.
    """
    w = W.partitionBy(group).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    level, at = F.col("level"), F.col(order)
    last = lambda cond: F.max(F.when(cond, at)).over(run)
    rows = rows.withColumn("c_at", last(level == 1)).withColumn("s_at", last(level.isin(2, 3))).withColumn("u_at", last(level == 4))
    for n in (1, 2, 3, 4):
        rows = rows.withColumn(f"l{n}_at", F.max(F.when(level == n, at)).over(w.rowsBetween(W.unboundedPreceding, -1)))
    known = F.col("c_at").isNotNull()
    named = lambda col: F.last(F.when(at == F.col(col), F.col("text")), ignorenulls=True).over(run)
    section = known & (F.col("s_at") > F.col("c_at"))
    sub = known & (F.col("u_at") > F.col("c_at")) & (F.coalesce(F.col("s_at"), F.lit(-1)) < F.col("u_at"))
    rows = rows.withColumn("chapter", named("c_at")).withColumn("section", F.when(section, named("s_at"))).withColumn("subsection", F.when(sub, named("u_at")))
    below = [F.when(level > n, F.col(f"l{n}_at")) for n in (1, 2, 3, 4)]
    rows = rows.withColumn("parent_line", F.when(known & (level > 1), F.greatest(*below)))
    ahead = W.partitionBy(group).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    body = level.isNull()
    for c in ("chapter", "section", "subsection"):
        rows = rows.withColumn(f"__{c}", F.struct(F.col(c)))
    for c in ("chapter", "section", "subsection"):
        nxt = F.first(F.when(body, F.col(f"__{c}")), ignorenulls=True).over(ahead)
        rows = rows.withColumn(c, F.when(body | nxt.isNull(), F.col(c)).otherwise(nxt[c]))
    return rows.drop("c_at", "s_at", "u_at", "l1_at", "l2_at", "l3_at", "l4_at", "__chapter", "__section", "__subsection")


def latched(rows: DataFrame, on: Column, off: Column, name: str, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds ``name``: true from a row where ``on`` holds until the next where ``off`` does."""
    event = F.when(on, True).when(off, False)
    return rows.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))


def adjacent_runs(rows: DataFrame, key: Column, group: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Adds run: a new number whenever ``key`` differs from the line before, though it may have come up earlier."""
    w = W.partitionBy(group).orderBy(order)
    changed = (~F.lag(key).over(w).eqNullSafe(key)).cast("long")
    return rows.withColumn("run", F.sum(changed).over(w.rowsBetween(W.unboundedPreceding, 0)))


# -- chunks ---------------------------------------------------------------------------------------------------


def spans(weights: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of greedy chunks: lines are added while the weight stays within ``target`` (one at least).

    The next chunk starts as far back from the end as makes ``overlap`` of common weight, but after this start.
    """
    found, start = [], 0
    while start < len(weights):
        end, total = start, 0
        while end < len(weights) and (end == start or total + weights[end] <= target):
            total += weights[end]
            end += 1
        found.append((start, end))
        if end == len(weights):
            break
        start, at, shared = end, end, 0
        while overlap and at > found[-1][0] + 1 and shared < overlap:
            at -= 1
            shared += weights[at]
        start = at
    return found


_SPAN = {"parent_no": "bigint", "chunk_no": "bigint", "first_line": "bigint", "last_line": "bigint", "text": "string"}


def _by_document(docs: DataFrame, cut, texts: bool = True) -> DataFrame:
    """``cut(weights, keys)`` gives (parent_no, chunk_no, start, end) for each document's row.

    Python holds a slice of documents at a time. Without ``texts`` it sees weights and keys alone.
    """
    names = list(_SPAN) if texts else list(_SPAN)[:4]

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:{_SPAN[n]}' for n in names)}>>")
    def spanned(ws: pa.Array, ks: pa.Array, *ls: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.string() if n == "text" else pa.int64()) for n in names]))
        made = [pa.array([], kind)]
        for at in range(0, len(ws), SLICE):
            part = [x.slice(at, SLICE).to_pylist() for x in (ws, ks, *ls)]
            rows = ([(p, c, i, j - 1, *("\n".join(x[i:j]) for x in own)) for p, c, i, j in cut(w, k)] for w, k, *own in zip(*part))
            made.append(pa.array([[dict(zip(names, x)) for x in row] for row in rows], kind))
        return pa.concat_arrays(made)

    found = docs.select("doc_id", spanned("weights", "keys", *(["lines"] if texts else [])).alias("spans")).select("doc_id", F.inline_outer("spans"))  # outer: else Spark would cut once more to look for empty lists
    if not texts:
        return found
    found = found.withColumn("token_count", token_count(F.col("text")))
    return found.withColumn("chunk_id", stable_id("chunk", F.col("doc_id"), F.col("first_line"), F.col("text")))


def _measured(docs: DataFrame, key=None) -> DataFrame:
    ls = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", ls.alias("lines"), F.transform(ls, line_weight).alias("weights"), F.transform(ls, key or (lambda x: F.lit(""))).alias("keys"))


def fixed_chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no, first_line, last_line, text, token_count, chunk_id: chunks that never split a line."""
    return _by_document(_measured(docs), lambda ws, _: [(0, n, a, b) for n, (a, b) in enumerate(spans(ws, target, overlap))]).drop("parent_no")


def parent_child_chunks(docs: DataFrame, key, parent: int = PARENT, target: int = TARGET, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """Runs of lines of equal ``key(line)`` are cut into parents without overlap, parents into children with it.

    Without ``texts`` there is no text, token_count and chunk_id.
    """

    def cut(ws: list[int], ks: list[str]) -> list[tuple[int, int, int, int]]:
        out, number, at = [], 0, 0
        while at < len(ks):
            stop = at
            while stop < len(ks) and ks[stop] == ks[at]:
                stop += 1
            for a, b in spans(ws[at:stop], parent, 0):
                out += [(number, n, at + a + c, at + a + e) for n, (c, e) in enumerate(spans(ws[at + a : at + b], target, overlap))]
                number += 1
            at = stop
        return out

    return _by_document(_measured(docs, key), cut, texts)


# -- anomalies ------------------------------------------------------------------------------------------------


def anomaly_score(rows: DataFrame) -> DataFrame:
    """Adds score and reasons from quality, n_chars, covered, heading_like, headings, noise and needs_ocr."""
    rules = [
        ("low_quality", F.when(F.col("quality") < 0.75, 5)),
        ("fair_quality", F.when((F.col("quality") >= 0.75) & (F.col("quality") < 0.9), 3)),
        ("uncovered", F.when((F.col("n_chars") >= 350) & ~F.col("covered"), 8)),
        ("missed_heading", F.when(F.col("heading_like") & (F.col("headings") == 0), 6)),
        ("many_headings", F.when(F.col("headings") >= 4, 2)),
        ("noise", F.when(F.col("noise") >= 3, F.least(F.lit(4), F.col("noise").cast("int")))),
        ("needs_ocr", F.when(F.col("needs_ocr"), 2)),
    ]
    score = sum((F.coalesce(points, F.lit(0)) for _, points in rules), F.lit(0)).cast("long")
    reasons = F.filter(F.array(*[F.when(points.isNotNull(), F.lit(name)) for name, points in rules]), lambda r: r.isNotNull())
    return rows.withColumn("score", score).withColumn("reasons", reasons)


def portfolio(rows: DataFrame, group: str, quota: int) -> DataFrame:
    """``quota`` rows a group: first the best row of each reason, then by score; ``rows`` has doc_id, score and reasons."""
    each = rows.select(group, "doc_id", "score", F.explode("reasons").alias("reason"))
    best = each.withColumn("n", F.row_number().over(W.partitionBy(group, "reason").orderBy(F.desc("score"), "doc_id"))).where("n = 1").select("doc_id").distinct().withColumn("first", F.lit(0))
    ranked = rows.join(best, "doc_id", "left").withColumn("first", F.coalesce("first", F.lit(1)))
    place = F.row_number().over(W.partitionBy(group).orderBy("first", F.desc("score"), "doc_id"))
    return ranked.withColumn("place", place.cast("long")).where(F.col("place") <= quota).select(group, "doc_id", "score", "place")


def spaced_windows(rows: DataFrame, group: str, quota: int, distance: int = 5, width: int = 5) -> DataFrame:
    """``group``, anchor, first, last: pages by score, each at least ``distance`` from all chosen, with a window clipped to the group.

    ``rows`` has pos (the page's place) and score. The choice depends on all before it, so each group is done in one go over
    its best candidates: of any ``quota`` anchors, each rules out ``2 * distance`` places at most, so more aren't needed.
    """
    need = quota * 2 * distance
    top = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "pos"))
    last = rows.groupBy(group).agg(F.max("pos").alias("end"), F.min("pos").alias("begin"))
    few = rows.withColumn("n", top).where(F.col("n") <= need).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("n", "pos"))).alias("c")).join(last, group)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, cand, end, begin in part[[group, "c", "end", "begin"]].itertuples(index=False, name=None):
                chosen = []
                for x in cand:
                    if len(chosen) < quota and all(abs(x["pos"] - y) >= distance for y in chosen):
                        chosen.append(x["pos"])
                for p in chosen:
                    first = max(begin, min(p - width // 2, end - width + 1))
                    out.append((key, p, first, min(end, first + width - 1)))
            yield pd.DataFrame(out, columns=[group, "anchor", "first", "last"])

    return few.mapInPandas(run, f"{group} {dict(rows.dtypes)[group]}, anchor long, first long, last long")


def even_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """About ``n`` rows a group, a fixed stride apart."""
    w = W.partitionBy(group)
    stride = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / F.lit(float(n))))
    rows = rows.withColumn("__n", F.row_number().over(w.orderBy(order)) - 1).withColumn("__s", stride)
    return rows.where(F.pmod("__n", "__s") == 0).drop("__n", "__s")
