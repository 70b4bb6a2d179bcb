"""Corpus: documents as pages of lines, sources as books, raw pages as HTML."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import audit_quality, diacritic_ratio, native_quality, needs_ocr, token_count
from corpusloom.operators import structure as st
from corpusloom.sources.tables import table

QUERIES, ORACLES = {}, {}
MARKS = "àâäáãåçèêëéìîïíñòôöóõùûüúßæœ"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


SIZE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query("page_quality", rf"""
WITH x AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(65533), '')) AS bad, len(regexp_extract_all(text, '\p{{L}}')) AS l, len(regexp_extract_all(text, '[{MARKS}]')) AS d FROM documents)
SELECT doc_id, round(least(n / 500.0::DOUBLE, 1) * (1 - bad::DOUBLE / greatest(n, 1)), 4)::DOUBLE AS quality, (n < 100 OR bad::DOUBLE / greatest(n, 1) > 0.05) AS needs_ocr,
 round((CASE WHEN n < 50 THEN 0.1 WHEN n < 200 THEN 0.5 ELSE 1 END)::DOUBLE * (CASE WHEN bad::DOUBLE / greatest(n, 1) > 0.1 THEN 0.2 WHEN bad::DOUBLE / greatest(n, 1) > 0.05 THEN 0.5 ELSE 1 END)::DOUBLE
   * (CASE WHEN l > 50 AND d::DOUBLE / greatest(l, 1) < 0.02 THEN 0.3 ELSE 1 END)::DOUBLE, 4)::DOUBLE AS audit
FROM x""")
def page_quality(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", native_quality(t).alias("quality"), needs_ocr(t).alias("needs_ocr"), audit_quality(t, MARKS).alias("audit"))


@query("ocr_quality")
def ocr_quality(spark, d):
    """Length and the share of letters with combining marks; decomposition isn't a built-in of either engine."""
    return table(spark, d, "documents").select("doc_id", F.round(F.least(F.length("text") / 500.0, F.lit(1.0)) * F.least(diacritic_ratio("text") / 0.08, F.lit(1.0)), 4).alias("quality"))


@query("document_audit", rf"""
SELECT source, count(*) AS pages, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean_chars, count(*) FILTER (WHERE length(text) < 100) AS short_pages,
 min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def document_audit(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.count_if(n < 100).alias("short_pages"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.countDistinct("lang").alias("langs"))


@query("repeated_lines", f"""
WITH {LINES}, n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM lines GROUP BY 1),
s AS (SELECT lang, trim(text, ' ') AS text, count(DISTINCT doc_id) AS pages FROM lines WHERE length(trim(text, ' ')) BETWEEN 4 AND 199 GROUP BY 1, 2)
SELECT * FROM (SELECT lang, text, pages, row_number() OVER (PARTITION BY lang ORDER BY pages DESC, text) AS rank FROM s JOIN n USING (lang) WHERE pages::DOUBLE / n >= 0.01) WHERE rank <= 20""")
def repeated_lines(spark, d):
    return st.repeated_lines(st.lines(table(spark, d, "documents"), "lang"), "lang", "doc_id", 0.01)


def placed_lines(spark, d):
    """Lines with a place on their page: the first and the last stand in the margins; numbers on some of them."""
    rows = st.lines(table(spark, d, "documents"), "lang")
    rows = rows.withColumn("y", F.when(F.col("line_no") == 0, 0.05).when(F.col("line_no") == 1, 0.9).otherwise(0.5))
    text = F.when((F.col("line_no") == 1) & (F.col("doc_id") % 3 == 0), F.col("doc_id").cast("string")).when((F.col("line_no") == 0) & (F.col("doc_id") % 10 > 0), F.lit("Volume  2 Header")).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumnRenamed("doc_id", "page_id")


@query("marginal_roles", rf"""
WITH {LINES}, p AS (SELECT doc_id AS page_id, lang, line_no, CASE line_no WHEN 0 THEN 'header' WHEN 1 THEN 'footer' END AS zone,
  CASE WHEN line_no = 1 AND doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN line_no = 0 AND doc_id % 10 > 0 THEN 'Volume  2 Header' ELSE text END AS text FROM lines),
q AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g') AS norm FROM p),
n AS (SELECT lang, count(DISTINCT page_id) AS n FROM q GROUP BY 1),
r AS (SELECT lang, zone, norm FROM q JOIN n USING (lang) WHERE zone IS NOT NULL GROUP BY lang, zone, norm, n HAVING count(DISTINCT page_id) >= ceil(n * 0.8::DOUBLE))
SELECT q.page_id, q.line_no, CASE WHEN q.zone IS NOT NULL AND regexp_matches(trim(text, ' '), '^([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,4}})$') THEN 'page_number' WHEN r.norm IS NOT NULL THEN q.zone ELSE 'body' END AS role
FROM q LEFT JOIN r ON r.lang = q.lang AND r.zone = q.zone AND r.norm = q.norm""")
def marginal_roles(spark, d):
    return st.marginal_roles(placed_lines(spark, d), "lang").select("page_id", "line_no", "role")


#: Lines of the documents, some with what starts a heading put before them.
HEADED = f"""{LINES}, headed AS (SELECT doc_id, line_no, doc_id % 2 = 1 AS scanned, line_no % 2 = 0 AS bold, CASE
  WHEN line_no % 23 = 1 THEN 'Chapter ' || (line_no // 23 + 1) WHEN line_no % 23 = 3 THEN 'II. ' || upper(replace(substr(text, 1, 30), 'ß', 'ss')) WHEN line_no % 23 = 6 THEN '1.2. ' || substr(text, 1, 40)
  WHEN line_no % 23 = 9 THEN 'a) ' || substr(text, 1, 40) WHEN line_no % 23 = 11 THEN 'IV - ' || substr(text, 1, 20) WHEN line_no % 23 = 14 THEN '* ' || substr(text, 1, 20)
  WHEN line_no % 23 = 16 THEN 'Contents' WHEN line_no % 23 = 19 THEN 'Conclusion' ELSE text END AS text FROM lines)"""

_T = "trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ')"
LEVELS = rf"""{HEADED}, t AS (SELECT *, {_T} AS t FROM headed),
leveled AS (SELECT doc_id, line_no, text, (CASE WHEN length(t) = 0 OR length(t) > 180 THEN NULL
  WHEN regexp_matches(t, '{st.CHAPTER}') AND upper(regexp_extract(t, '{st.CHAPTER}', 2)) = regexp_extract(t, '{st.CHAPTER}', 2) THEN 1
  WHEN regexp_matches(t, '{st.ROMAN_DASH}') THEN 2
  WHEN regexp_matches(t, '{st.ROMAN_DOT}') AND (upper(t) = t OR (scanned AND length(t) <= 160 AND NOT regexp_matches(t, '[.,;:!?]$'))) THEN 2
  WHEN regexp_matches(t, '{st.LETTER_DOT}') AND upper(t) = t THEN 2
  WHEN regexp_matches(t, '{st.NUMBERED}') AND length(t) <= 160 AND (bold OR (scanned AND NOT regexp_matches(t, '[.,;:!?]$'))) THEN 3
  WHEN regexp_matches(t, '{st.LETTER_PAREN}') AND length(t) <= 120 AND (bold OR NOT scanned OR NOT regexp_matches(t, '[.,;:!?]$')) THEN 4
  WHEN regexp_matches(t, '{st.BULLET}') AND bold AND length(t) <= 100 THEN 5 END)::BIGINT AS level FROM t)"""


def headed(spark, d):
    n, t = F.col("line_no") % 23, F.col("text")
    cut = lambda k: F.substring(t, 1, k)
    text = (
        F.when(n == 1, F.concat(F.lit("Chapter "), F.floor(F.col("line_no") / 23) + 1)).when(n == 3, F.concat(F.lit("II. "), F.upper(F.replace(cut(30), F.lit("ß"), F.lit("ss"))))).when(n == 6, F.concat(F.lit("1.2. "), cut(40)))
        .when(n == 9, F.concat(F.lit("a) "), cut(40))).when(n == 11, F.concat(F.lit("IV - "), cut(20))).when(n == 14, F.concat(F.lit("* "), cut(20))).when(n == 16, "Contents").when(n == 19, "Conclusion").otherwise(t)
    )
    rows = st.lines(table(spark, d, "documents")).withColumn("scanned", F.col("doc_id") % 2 == 1).withColumn("bold", F.col("line_no") % 2 == 0).withColumn("text", text)
    return rows.withColumn("level", st.heading_level(F.col("text"), F.col("bold"), F.col("scanned")))


@query("heading_levels", f"WITH {LEVELS} SELECT doc_id, line_no, level FROM leveled WHERE level IS NOT NULL")
def heading_levels(spark, d):
    return headed(spark, d).where("level is not null").select("doc_id", "line_no", "level")


@query("section_fill", f"""
WITH {LEVELS},
a AS (SELECT *, max(line_no) FILTER (WHERE level = 1) OVER w AS c, max(line_no) FILTER (WHERE level IN (2, 3)) OVER w AS s, max(line_no) FILTER (WHERE level = 4) OVER w AS u
  FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT a.doc_id, a.line_no, a.level, c, CASE WHEN s > c THEN s END AS s, CASE WHEN u > c AND coalesce(s, -1) < u THEN u END AS u FROM a),
b AS (SELECT p.doc_id, p.line_no, p.level, (SELECT min(x.line_no) FROM leveled x WHERE x.doc_id = p.doc_id AND x.line_no >= p.line_no AND x.level IS NULL) AS body FROM p),
r AS (SELECT b.doc_id, b.line_no, b.level, coalesce(y.line_no, b.line_no) AS at FROM b LEFT JOIN p y ON y.doc_id = b.doc_id AND y.line_no = b.body),
f AS (SELECT r.doc_id, r.line_no, r.level, p.c, p.s, p.u FROM r JOIN p ON p.doc_id = r.doc_id AND p.line_no = r.at)
SELECT f.doc_id, f.line_no, c.text AS chapter, s.text AS section, u.text AS subsection,
 CASE WHEN f.level > 1 AND own.c IS NOT NULL THEN (SELECT max(x.line_no) FROM leveled x WHERE x.doc_id = f.doc_id AND x.line_no < f.line_no AND x.level < f.level) END AS parent_line
FROM f JOIN p own ON own.doc_id = f.doc_id AND own.line_no = f.line_no
LEFT JOIN leveled c ON c.doc_id = f.doc_id AND c.line_no = f.c LEFT JOIN leveled s ON s.doc_id = f.doc_id AND s.line_no = f.s LEFT JOIN leveled u ON u.doc_id = f.doc_id AND u.line_no = f.u""")
def section_fill(spark, d):
    return st.section_paths(headed(spark, d)).select("doc_id", "line_no", "chapter", "section", "subsection", "parent_line")


@query("latched_zones", f"""
WITH {HEADED}, e AS (SELECT doc_id, line_no, CASE WHEN text = 'Contents' THEN 1 WHEN text = 'Conclusion' OR starts_with(text, 'Chapter ') THEN 0 END AS e FROM headed)
SELECT doc_id, line_no, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS excluded FROM e""")
def latched_zones(spark, d):
    t = F.col("text")
    return st.latched(headed(spark, d), t == "Contents", (t == "Conclusion") | t.startswith("Chapter "), "excluded").select("doc_id", "line_no", "excluded")


@query("continuation_merge", f"""
WITH {LEVELS}, n AS (SELECT *, lead(text) OVER w AS following, lead(level) OVER w AS fl FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT doc_id, line_no, text, CASE WHEN fl IS NULL AND following IS NOT NULL AND length(following) BETWEEN 1 AND 80 THEN following END AS f FROM n WHERE level = 1)
SELECT doc_id, line_no, CASE WHEN f IS NULL THEN text ELSE text || ' ' || f END AS heading, f IS NOT NULL AS absorbed FROM h""")
def continuation_merge(spark, d):
    """A chapter heading takes in a short body line that follows."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = headed(spark, d).withColumn("f", F.lead("text").over(w)).withColumn("fl", F.lead("level").over(w)).where("level = 1")
    takes = F.col("fl").isNull() & F.col("f").isNotNull() & F.length("f").between(1, 80)
    return rows.select("doc_id", "line_no", F.when(takes, F.concat_ws(" ", "text", "f")).otherwise(F.col("text")).alias("heading"), F.coalesce(takes, F.lit(False)).alias("absorbed"))


KIND = "CASE WHEN contains(text, ' | ') THEN 'table' WHEN upper(text) = text THEN 'upper' ELSE 'prose' END"


def kind(x):
    return F.when(F.contains(x, F.lit(" | ")), "table").when(F.upper(x) == x, "upper").otherwise("prose")


RUNS = f"""{LINES}, k AS (SELECT *, {KIND} AS kind FROM lines),
runs AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM (
  SELECT *, (lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM kind)::INT AS ch FROM k))"""


@query("adjacent_runs", f"WITH {RUNS} SELECT doc_id, run, kind, min(line_no) AS first_line, count(*) AS n_lines FROM runs GROUP BY 1, 2, 3")
def adjacent_runs(spark, d):
    rows = st.lines(table(spark, d, "documents")).withColumn("kind", kind(F.col("text")))
    return st.adjacent_runs(rows, F.col("kind")).groupBy("doc_id", "run", "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


@query("body_lines", rf"WITH {LINES} SELECT doc_id, line_no, greatest(1, len(regexp_extract_all(text, '{SIZE}')))::BIGINT AS tokens FROM lines WHERE trim(text, ' ') <> ''")
def body_lines(spark, d):
    return st.lines(table(spark, d, "documents")).where(F.trim("text") != "").select("doc_id", "line_no", st.line_weight(F.col("text")).alias("tokens"))


def _packed(source: str, target: int, overlap: int, name: str) -> str:
    """Recursive CTE ``name`` (keys, s, e) over ``source`` (keys..., w list of weights)."""
    return f"""
{name}_c AS (SELECT *, list_prepend(0::BIGINT, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])::BIGINT)) AS cum FROM {source}),
{name} AS (SELECT k, cum, 0::BIGINT AS no, 0::BIGINT AS s, greatest(1, len(list_filter(cum, lambda c: c <= {target})) - 1)::BIGINT AS e FROM {name}_c
 UNION ALL SELECT k, cum, no + 1, p, greatest(p + 1, len(list_filter(cum, lambda c: c - cum[p + 1] <= {target})) - 1)::BIGINT FROM (
  SELECT k, cum, no, {f"greatest(s + 1, len(list_filter(cum, lambda c: cum[e + 1] - c >= {overlap})) - 1)::BIGINT" if overlap else "e"} AS p FROM {name} WHERE e < len(cum) - 1))"""


@query("chunk_fixed", rf"""
WITH RECURSIVE {LINES}, docs AS (SELECT doc_id AS k, list(greatest(1, len(regexp_extract_all(text, '{SIZE}')))::BIGINT ORDER BY line_no) AS w FROM lines GROUP BY doc_id), {_packed('docs', 400, 50, 'c')},
t AS (SELECT c.k AS doc_id, no AS chunk_no, s AS first_line, e - 1 AS last_line, array_to_string(string_split(text, chr(10))[s + 1:e], chr(10)) AS text FROM c JOIN documents ON doc_id = c.k)
SELECT doc_id, chunk_no, first_line, last_line, len(regexp_extract_all(text, '{SIZE}'))::BIGINT AS token_count,
 'chunk_' || substr(sha256(doc_id || chr(10) || first_line || chr(10) || text), 1, 16) AS chunk_id FROM t""")
def chunk_fixed(spark, d):
    return st.fixed_chunks(table(spark, d, "documents")).drop("text")


@query("chunk_parent_child", rf"""
WITH RECURSIVE {RUNS},
rl AS (SELECT {{'doc': doc_id, 'run': run, 'at': min(line_no)}} AS k, list(greatest(1, len(regexp_extract_all(text, '{SIZE}')))::BIGINT ORDER BY line_no) AS w FROM runs GROUP BY doc_id, run), {_packed('rl', 1500, 0, 'p')},
pp AS (SELECT k.doc AS doc, k.at + s AS pos, e - s AS n, row_number() OVER (PARTITION BY k.doc ORDER BY k.at + s) - 1 AS parent_no FROM p),
cw AS (SELECT {{'doc': pp.doc, 'parent': parent_no, 'at': pos}} AS k, list(greatest(1, len(regexp_extract_all(text, '{SIZE}')))::BIGINT ORDER BY line_no) AS w FROM pp JOIN lines ON doc_id = pp.doc AND line_no >= pos AND line_no < pos + n GROUP BY pp.doc, parent_no, pos), {_packed('cw', 400, 50, 'c')}
SELECT k.doc AS doc_id, k.parent AS parent_no, no AS chunk_no, k.at + s AS first_line, k.at + e - 1 AS last_line FROM c""")
def chunk_parent_child(spark, d):
    return st.parent_child_chunks(table(spark, d, "documents"), kind, texts=False).select("doc_id", "parent_no", "chunk_no", "first_line", "last_line")


SCORED = rf"""x AS (SELECT doc_id, source, length(text) AS n_chars, round(least(length(text) / 500.0::DOUBLE, 1), 4) AS quality, doc_id % 5 > 0 AS covered,
  regexp_matches(text, '(^|\n)[A-Z][A-Z !]+') AS hl, len(regexp_extract_all(text, '!!'))::BIGINT % 6 AS headings, len(regexp_extract_all(text, '[*$%&#]{{3}}'))::BIGINT AS noise, length(text) < 100 AS ocr FROM documents),
s AS (SELECT *, (CASE WHEN quality < 0.75 THEN 5 WHEN quality < 0.9 THEN 3 ELSE 0 END + CASE WHEN n_chars >= 350 AND NOT covered THEN 8 ELSE 0 END + CASE WHEN hl AND headings = 0 THEN 6 ELSE 0 END
  + CASE WHEN headings >= 4 THEN 2 ELSE 0 END + CASE WHEN noise >= 3 THEN least(4, noise) ELSE 0 END + CASE WHEN ocr THEN 2 ELSE 0 END)::BIGINT AS score,
  list_filter([CASE WHEN quality < 0.75 THEN 'low_quality' END, CASE WHEN quality >= 0.75 AND quality < 0.9 THEN 'fair_quality' END, CASE WHEN n_chars >= 350 AND NOT covered THEN 'uncovered' END,
   CASE WHEN hl AND headings = 0 THEN 'missed_heading' END, CASE WHEN headings >= 4 THEN 'many_headings' END, CASE WHEN noise >= 3 THEN 'noise' END, CASE WHEN ocr THEN 'needs_ocr' END], lambda r: r IS NOT NULL) AS reasons FROM x)"""


def scored_pages(spark, d):
    t = F.col("text")
    rows = table(spark, d, "documents").select(
        "doc_id", "source", F.length(t).alias("n_chars"), F.round(F.least(F.length(t) / 500.0, F.lit(1.0)), 4).alias("quality"), (F.col("doc_id") % 5 > 0).alias("covered"), t.rlike(r"(^|\n)[A-Z][A-Z !]+").alias("heading_like"),
        (F.regexp_count(t, F.lit("!!")) % 6).alias("headings"), F.regexp_count(t, F.lit("[*$%&#]{3}")).alias("noise"), (F.length(t) < 100).alias("needs_ocr"),
    )
    return st.anomaly_score(rows)


@query("anomaly_score", f"WITH {SCORED} SELECT doc_id, source, score, array_to_string(reasons, ',') AS reasons FROM s")
def anomaly_score(spark, d):
    return scored_pages(spark, d).select("doc_id", "source", "score", F.array_join("reasons", ",").alias("reasons"))


@query("portfolio_select", f"""
WITH {SCORED}, e AS (SELECT doc_id, source, score, unnest(reasons) AS reason FROM s),
b AS (SELECT DISTINCT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, reason ORDER BY score DESC, doc_id) AS n FROM e) WHERE n = 1)
SELECT source, doc_id, score, place FROM (SELECT source, s.doc_id, score, row_number() OVER (PARTITION BY source ORDER BY (b.doc_id IS NULL)::INT, score DESC, s.doc_id) AS place FROM s LEFT JOIN b USING (doc_id)) WHERE place <= 10""")
def portfolio_select(spark, d):
    return st.portfolio(scored_pages(spark, d), "source", 10)


@query("anchor_windows")
def anchor_windows(spark, d):
    pos = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long")
    return st.spaced_windows(scored_pages(spark, d).withColumn("pos", pos), "source", 3)


@query("even_sample", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, greatest(1, ceil(count(*) OVER (PARTITION BY source) / 7.0)) AS stride FROM documents) WHERE n % stride = 0""")
def even_sample(spark, d):
    return st.even_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 7)


_H = r"regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
_H = f"regexp_replace(regexp_replace({_H}, '</?({st.BLOCK_TAGS})( [^>]*)?/?>', chr(30), 'g'), '<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _H = f"replace({_H}, '{_a}', '{_b}')"


@query("html_blocks", rf"""
WITH b AS (SELECT page_id, list_filter(list_transform(string_split(trim(regexp_replace({_H}, '[ \t\n\r]+', ' ', 'g'), ' '), chr(30)), lambda x: trim(x, ' ')), lambda x: x <> '') AS b FROM pages)
SELECT page_id, unnest(b) AS text, (generate_subscripts(b, 1) - 1)::BIGINT AS block_no FROM b""")
def html_blocks(spark, d):
    return st.html_blocks(table(spark, d, "pages"))


@query("size_histogram", f"""
WITH {LINES}, h AS (SELECT source, round(length(text) / 40.0, 0)::DOUBLE AS size, sum(length(text))::BIGINT AS chars FROM lines GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, size) AS rank FROM h) WHERE rank <= 10""")
def size_histogram(spark, d):
    """The commonest sizes weighted by characters, as of fonts; a line's length stands for its size."""
    h = st.lines(table(spark, d, "documents"), "source").groupBy("source", F.round(F.length("text") / 40.0, 0).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("chars"), "size")).cast("long")).where("rank <= 10")


@query("headings_detect", rf"WITH {LINES} SELECT doc_id, line_no, text FROM lines WHERE length(text) < 200 AND regexp_matches(text, '^(Chapter |[IVX]+\.|[0-9]+\.|[a-z]\)|[A-Z][A-Z !]+$)')")
def headings_detect(spark, d):
    return st.lines(table(spark, d, "documents")).where((F.length("text") < 200) & F.col("text").rlike(r"^(Chapter |[IVX]+\.|[0-9]+\.|[a-z]\)|[A-Z][A-Z !]+$)"))


@query("printed_page", rf"""
WITH x AS (SELECT doc_id, list_append(string_split(text, chr(10)), doc_id::VARCHAR) AS l FROM documents),
y AS (SELECT doc_id, list_filter(list_transform(l[1:3] || l[greatest(4, len(l) - 2):len(l)], lambda t: trim(t, ' ')), lambda t: regexp_matches(t, '^([0-9]{{1,4}}|[ivxlcdm]+)$')) AS f FROM x)
SELECT doc_id, f[1] AS printed FROM y""")
def printed_page(spark, d):
    """The first number or roman numeral among a page's first and last three lines; each page ends in its number here."""
    ls = F.array_append(F.split("text", "\n", -1), F.col("doc_id").cast("string"))
    n = F.size(ls)
    start = F.greatest(F.lit(4), n - 2)
    ends = F.concat(F.slice(ls, 1, 3), F.slice(ls, start, F.greatest(F.lit(0), n - start + 1)))
    found = F.filter(F.transform(ends, lambda t: F.trim(t)), lambda t: t.rlike("^([0-9]{1,4}|[ivxlcdm]+)$"))
    return table(spark, d, "documents").select("doc_id", F.try_element_at(found, F.lit(1)).alias("printed"))


@query("table_lines", rf"WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE len(string_split(text, ' | ')) >= 3) AS table_lines, max(len(string_split(text, ' | ')))::BIGINT AS most_columns FROM lines GROUP BY doc_id")
def table_lines(spark, d):
    n = F.size(F.split("text", r" \| ", -1))
    return st.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.count_if(n >= 3).alias("table_lines"), F.max(n).cast("long").alias("most_columns"))


@query("layout_columns", f"""
WITH {LINES}, b AS (SELECT doc_id, line_no, (line_no % 2) * 300 AS x, (line_no // 2) * 60 AS y0, (line_no // 2) * 60 + least(length(text), 100) AS y1 FROM lines)
SELECT d.doc_id, coalesce(bool_or(r.line_no IS NOT NULL), false) AS multi_column FROM documents d LEFT JOIN b l ON l.doc_id = d.doc_id AND l.x < 250
LEFT JOIN b r ON r.doc_id = d.doc_id AND r.x >= 250 AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 50 GROUP BY d.doc_id""")
def layout_columns(spark, d):
    """A left and a right block side by side over more than 50 points; blocks are set out from line numbers."""
    n = F.col("line_no")
    y = F.floor(n / 2) * 60
    b = st.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.collect_list(F.struct((n % 2 * 300).alias("x"), y.alias("y0"), (y + F.least(F.length("text"), F.lit(100))).alias("y1"))).alias("b"))
    left, right = F.filter("b", lambda x: x["x"] < 250), F.filter("b", lambda x: x["x"] >= 250)
    side = lambda a: F.exists(right, lambda r: F.least(a["y1"], r["y1"]) - F.greatest(a["y0"], r["y0"]) > 50)
    return b.select("doc_id", F.exists(left, side).alias("multi_column"))


@query("token_sizes", rf"SELECT doc_id, len(regexp_extract_all(text, '{SIZE}'))::BIGINT AS tokens FROM documents")
def token_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
