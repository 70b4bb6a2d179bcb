"""Retrieval: the benchmark's items as questions, documents as chunks, embeddings as their dense index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse
from corpusloom.operators import dense, fusion, lexical, routing
from corpusloom.queries import sql
from corpusloom.sources.tables import table

LEXICAL, DENSE, FUSED, SHOWN = 30, 30, 24, 10

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of an item is that of the same number: embedding texts is a model's task, behind a plug point."""
    vectors = table(spark, d, "embeddings")
    return table(spark, d, "benchmark").select("item_id").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")


def lexical_lane(spark: SparkSession, d: str, k: int = LEXICAL) -> DataFrame:
    return lexical.bm25(table(spark, d, "documents"), items(spark, d), k)


def dense_lane(spark: SparkSession, d: str, k: int = DENSE) -> DataFrame:
    return dense.cosine_top_k(table(spark, d, "embeddings"), item_vectors(spark, d), k).withColumnRenamed("vec_id", "doc_id")


LANES = f"{sql.ITEMS}, {sql.VECTORS}, {sql.bm25('items', 'documents', LEXICAL, 'lex')}, {sql.cosine('vectors', DENSE, 'den')}"


@query("bm25_topk", f"WITH {sql.ITEMS}, {sql.bm25('items', 'documents', SHOWN, 'lex')} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_topk(spark, d):
    return lexical_lane(spark, d, SHOWN).select("query_id", "doc_id", "score", "rank")


@query("bm25_filtered", f"WITH {sql.ITEMS}, {sql.bm25('items', 'documents', SHOWN, 'lex', keep='lang IN (chr(102) || chr(114), chr(100) || chr(101))')} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_filtered(spark, d):
    """Statistics of all documents, results of two languages alone."""
    return lexical.bm25(table(spark, d, "documents"), items(spark, d), SHOWN, keep=F.col("lang").isin("fr", "de")).select("query_id", "doc_id", "score", "rank")


@query("bm25_local_index", f"WITH {sql.ITEMS}, part AS (SELECT * FROM documents WHERE lang = 'fr'), {sql.bm25('items', 'part', SHOWN, 'lex')} SELECT query_id, doc_id, score, rank FROM lex")
def bm25_local_index(spark, d):
    """An index of one language: statistics of its documents alone."""
    return lexical.bm25(table(spark, d, "documents").where("lang = 'fr'"), items(spark, d), SHOWN).select("query_id", "doc_id", "score", "rank")


@query("bm25_postings", rf"""
WITH t AS (SELECT doc_id, {sql.tok('text')} AS t FROM documents),
p AS (SELECT doc_id, len(t) AS n_tokens, unnest(t) AS term FROM t)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, term, count(*) AS tf FROM p GROUP BY ALL""")
def bm25_postings(spark, d):
    return lexical.postings(table(spark, d, "documents"))


@query("bm25_idf", rf"""
WITH t AS (SELECT doc_id, unnest(list_distinct({sql.tok('text')})) AS term FROM documents)
SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term""")
def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    from corpusloom.functions.text import tokens

    df = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n")
    return df.join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("dense_index", """
SELECT vec_id, label::BIGINT AS label, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS square, len(embedding)::BIGINT AS dim FROM embeddings""")
def dense_index(spark, d):
    """Vectors checked and normalised: unit squares."""
    unit = dense.normalized(table(spark, d, "embeddings"))
    return unit.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("vec_id", F.col("label").cast("long").alias("label"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"), F.size("unit").cast("long").alias("dim"))


@query("dense_topk", f"WITH {sql.VECTORS}, {sql.cosine('vectors', SHOWN, 'den')} SELECT query_id, doc_id, score, rank FROM den")
def dense_topk(spark, d):
    return dense_lane(spark, d, SHOWN).select("query_id", "doc_id", "score", "rank")


@query("dense_fanout_topk", f"WITH {sql.VECTORS}, {sql.cosine('vectors', SHOWN, 'den')} SELECT query_id, doc_id, label::BIGINT AS label, score, rank FROM den")
def dense_fanout_topk(spark, d):
    """Each label's vectors searched by themselves, the lists merged."""
    found = dense.cosine_top_k(table(spark, d, "embeddings"), item_vectors(spark, d), SHOWN, partition="label")
    return found.select("query_id", F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label"), "score", "rank")


@query("dense_scope", f"WITH {sql.VECTORS}, {sql.cosine('vectors', SHOWN, 'den', 'label IN (1, 3)')} SELECT query_id, doc_id, score, rank FROM den")
def dense_scope(spark, d):
    """Within a set of partitions; None would be all of them, the empty set none."""
    scoped = routing.in_scope(table(spark, d, "embeddings"), "label", {1, 3})
    found = dense.cosine_top_k(scoped, item_vectors(spark, d), SHOWN)
    return found.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


@query("rrf_fusion", f"WITH {LANES}, {sql.rrf(['lex', 'den'], FUSED, 'fused')} SELECT query_id, doc_id, score, first_list, rank FROM fused")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank_fusion([lexical_lane(spark, d), dense_lane(spark, d)], FUSED).select("query_id", "doc_id", "score", "first_list", "rank")


@query("rrf_positional", f"""
WITH {LANES}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lex WHERE rank > 2),
{sql.rrf(['a', 'den'], SHOWN, 'fused')} SELECT query_id, doc_id, score, rank FROM fused""")
def rrf_positional(spark, d):
    """A list whose stored ranks begin later is ranked by place."""
    gaps = lexical_lane(spark, d).where("rank > 2")
    return fusion.reciprocal_rank_fusion([gaps, dense_lane(spark, d)], SHOWN, positional=True).select("query_id", "doc_id", "score", "rank")


HYBRID = f"WITH {LANES}, {sql.rrf(['lex', 'den'], SHOWN, 'fused')} SELECT query_id, doc_id, lang, score, rank FROM fused JOIN documents USING (doc_id)"


@query("hybrid_topk", HYBRID)
def hybrid_topk(spark, d):
    """The flagship: both lanes, fused, with the documents' language."""
    fused = fusion.reciprocal_rank_fusion([lexical_lane(spark, d), dense_lane(spark, d)], SHOWN)
    return table(spark, d, "documents").select("doc_id", "lang").join(fused, "doc_id").select("query_id", "doc_id", "lang", "score", "rank")


@query("candidate_overfetch", f"""
WITH {LANES}, {sql.rrf(['lex', 'den'], FUSED, 'fused')},
f AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fused JOIN documents USING (doc_id) WHERE n_chars >= 500)
SELECT query_id, doc_id, score, rank FROM f WHERE rank <= 12""")
def candidate_overfetch(spark, d):
    """Twice the candidates, those of a substantive length, cut to 12."""
    fused = fusion.reciprocal_rank_fusion([lexical_lane(spark, d), dense_lane(spark, d)], FUSED)
    kept = table(spark, d, "documents").where("n_chars >= 500").select("doc_id").join(fused, "doc_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long")
    return kept.select("query_id", "doc_id", "score", place.alias("rank")).where("rank <= 12")


@query("rerank_topk", rf"""
WITH {LANES}, {sql.rrf(['lex', 'den'], FUSED, 'fused')},
p AS (SELECT f.query_id, f.doc_id, list_distinct({sql.tok('i.text')}) AS q, list_distinct({sql.tok('x.text')}) AS t
  FROM fused f JOIN items i USING (query_id) JOIN documents x USING (doc_id)),
s AS (SELECT query_id, doc_id, round(len(list_intersect(q, t))::DOUBLE / len(q), 6) AS score FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_topk(spark, d):
    fused = fusion.reciprocal_rank_fusion([lexical_lane(spark, d), dense_lane(spark, d)], FUSED)
    return fusion.rerank(fused, items(spark, d), table(spark, d, "documents"), 5)


@query("round_robin_merge", f"""
WITH {LANES}, r AS (SELECT query_id, doc_id, score, rank AS depth, 0 AS l FROM lex UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM den),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY depth, l) AS n FROM r) WHERE n = 1)
SELECT query_id, doc_id, score, rank, l::BIGINT AS list_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, l) AS rank FROM u) WHERE rank <= 12""")
def round_robin_merge(spark, d):
    return fusion.round_robin([lexical_lane(spark, d), dense_lane(spark, d)], 12)


@query("merge_max_score", f"""
WITH {LANES}, r AS (SELECT query_id, doc_id, score, 0 AS l FROM lex UNION ALL SELECT query_id, doc_id, score, 1 FROM den)
SELECT query_id, doc_id, max(score) AS score, arg_max(l, struct_pack(s := score, l := -l))::BIGINT AS list_no FROM r GROUP BY 1, 2""")
def merge_max_score(spark, d):
    return fusion.merge_best(lexical_lane(spark, d), dense_lane(spark, d))


@query("merge_last_wins", f"""
WITH {LANES} SELECT query_id, doc_id, coalesce(b.score, a.score) AS score, (b.score IS NOT NULL)::BIGINT AS list_no
FROM lex a FULL JOIN den b USING (query_id, doc_id)""")
def merge_last_wins(spark, d):
    return fusion.merge_last(lexical_lane(spark, d), dense_lane(spark, d))


@query("new_evidence", f"WITH {LANES} SELECT query_id, doc_id, score, rank FROM den WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM lex)")
def new_evidence(spark, d):
    return fusion.new_evidence(dense_lane(spark, d), lexical_lane(spark, d)).select("query_id", "doc_id", "score", "rank")


LINES = r"""lines AS (SELECT doc_id AS parent_id, doc_id * 10000 + n AS doc_id, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"""


def children(spark: SparkSession, d: str) -> DataFrame:
    """Lines as child chunks of their document."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return lines.select("parent_id", (F.col("parent_id") * 10000 + F.col("n") + 1).alias("doc_id"), "text")


@query("parent_expansion", f"""
WITH {sql.ITEMS}, {LINES}, {sql.bm25('items', 'lines', 30, 'lex')},
j AS (SELECT l.query_id, p.parent_id, l.score, l.rank, row_number() OVER (PARTITION BY l.query_id, p.parent_id ORDER BY l.rank) AS n FROM lex l JOIN lines p USING (doc_id)),
r AS (SELECT query_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM j WHERE n = 1)
SELECT query_id, parent_id, score, rank FROM r WHERE rank <= 10""")
def parent_expansion(spark, d):
    lines = children(spark, d)
    found = lexical.bm25(lines, items(spark, d), 30).withColumnRenamed("doc_id", "child_id")
    return fusion.expand_to_parents(found, lines.select(F.col("doc_id").alias("child_id"), "parent_id"), 10)


GATED = f"""WITH {sql.ITEMS}, {sql.bm25('items', 'documents', SHOWN, 'lex')},
b AS (SELECT query_id, best FROM items LEFT JOIN (SELECT query_id, max(score) AS best FROM lex GROUP BY 1) USING (query_id))"""


@query("evidence_gate", f"{GATED} SELECT query_id, best, CASE WHEN best >= 40 THEN 'generate' WHEN best >= 15 THEN 'rewrite' ELSE 'refuse_out_of_domain' END AS decision FROM b")
def evidence_gate(spark, d):
    return fusion.gate(lexical_lane(spark, d, SHOWN), items(spark, d), 40, 15)


@query("evidence_gate_second_try", f"{GATED} SELECT query_id, best, CASE WHEN best >= 40 THEN 'generate' WHEN best >= 15 THEN 'refuse_insufficient' ELSE 'refuse_out_of_domain' END AS decision FROM b")
def evidence_gate_second_try(spark, d):
    return fusion.gate(lexical_lane(spark, d, SHOWN), items(spark, d), 40, 15, rewritten=True)


@query("support_gated_insertion", rf"""
WITH {LANES}, base AS (SELECT * FROM lex WHERE rank <= 10),
cand AS (SELECT query_id, doc_id, 0 AS target_no, rank AS place FROM den WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1, rank - 5 FROM den WHERE rank > 5 AND rank <= 10),
pool AS (SELECT * FROM cand UNION ALL SELECT b.query_id, b.doc_id, t, 100 + b.rank FROM base b, (VALUES (0), (1)) x(t) WHERE b.rank <= 5),
p AS (SELECT query_id, target_no, doc_id, place, list_distinct({sql.tok('i.text')}) AS q, list_distinct({sql.tok('x.text')}) AS t FROM pool JOIN items i USING (query_id) JOIN documents x USING (doc_id)),
s AS (SELECT query_id, target_no, doc_id, place, round(len(list_intersect(q, t))::DOUBLE / len(q), 6) AS score FROM p),
old AS (SELECT query_id, target_no, max(score) AS old FROM s WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM base WHERE rank <= 5) GROUP BY 1, 2),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target_no ORDER BY score DESC, place, doc_id) AS n FROM s WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM base)) WHERE n = 1),
ok AS (SELECT query_id, doc_id, min(target_no) AS target_no FROM new JOIN old USING (query_id, target_no) WHERE score > old - 0.5 GROUP BY 1, 2),
ins AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY target_no, doc_id) AS n FROM ok),
c AS (SELECT query_id, least(count(*), 2) AS m FROM ins GROUP BY 1),
keep AS (SELECT b.query_id, b.doc_id, b.rank FROM base b LEFT JOIN c USING (query_id) WHERE b.rank <= 8 - coalesce(m, 0))
SELECT query_id, doc_id, rank, false AS inserted FROM keep UNION ALL
SELECT query_id, doc_id, (SELECT count(*) FROM keep k WHERE k.query_id = ins.query_id) + n AS rank, true FROM ins WHERE n <= 2""")
def support_gated_insertion(spark, d):
    """Two targeted queries (the dense list's first and second five); the overlap scorer stands in for a support model."""
    base, found = lexical_lane(spark, d, 10), dense_lane(spark, d, 10)
    low = F.col("rank") <= 5
    cand = found.select("query_id", "doc_id", F.when(low, 0).otherwise(1).alias("target_no"), F.when(low, F.col("rank")).otherwise(F.col("rank") - 5).alias("place"))
    own = base.where(low).select("query_id", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("target_no"), (F.col("rank") + 100).alias("place"))
    pool = cand.unionByName(own)
    scored = fusion.rerank(pool.select("query_id", "doc_id").distinct(), items(spark, d), table(spark, d, "documents"), 100)
    targeted = pool.join(scored.select("query_id", "doc_id", "score"), ["query_id", "doc_id"])
    return fusion.support_gated(base, targeted, 8, margin=-0.5)


@query("adjacent_expansion", rf"""
WITH {sql.ITEMS}, {sql.bm25('items', 'documents', 5, 'lex')},
o AS (SELECT doc_id, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, text FROM documents),
n AS (SELECT l.query_id, b.doc_id, l.doc_id AS seed_id, l.rank, b.text FROM lex l JOIN o a ON a.doc_id = l.doc_id JOIN o b ON b.grp = a.grp AND abs(b.pos - a.pos) = 1),
s AS (SELECT n.query_id, n.doc_id, seed_id, rank, round(1.0::DOUBLE / (60 + rank) + len(list_intersect(list_distinct({sql.tok('i.text')}), {sql.tok('n.text')}))::DOUBLE / len(list_distinct({sql.tok('i.text')})), 6) AS score
  FROM n JOIN items i USING (query_id) WHERE (n.query_id, n.doc_id) NOT IN (SELECT (query_id, doc_id) FROM lex))
SELECT query_id, doc_id, seed_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, rank) AS k FROM s) WHERE k = 1""")
def adjacent_expansion(spark, d):
    docs = table(spark, d, "documents")
    order = docs.select("doc_id", F.col("source").alias("grp"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("pos"), "text")
    return fusion.adjacent(lexical_lane(spark, d, 5), order, items(spark, d))


@query("question_route", r"""
WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ') AS t FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ') FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN regexp_matches(t, '(^|[^a-z0-9])[a-d][.)]') THEN 'mcq' WHEN contains(t, 'compare') OR contains(t, ' than ') THEN 'comparison'
  WHEN contains(t, 'quote') OR contains(t, '"') THEN 'exact_quote' WHEN contains(t, 'define') OR contains(t, 'what is') THEN 'definition'
  WHEN contains(t, 'discuss') OR contains(t, 'explain') THEN 'essay' ELSE 'general' END AS route,
  contains(t, 'weather') OR contains(t, 'football') AS out_of_scope FROM q""")
def question_route(spark, d):
    chats = table(spark, d, "conversations").where("role = 'user'").select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return routing.route_question(items(spark, d).unionByName(chats))


@query("subject_route", r"""
WITH p(subject, phrase) AS (VALUES ('en', ' the '), ('en', ' and '), ('en', ' of '), ('fr', ' le '), ('fr', ' et '), ('fr', ' de '), ('de', ' der '), ('de', ' und '), ('de', ' die '), ('es', ' el '), ('es', ' y '), ('es', ' de ')),
h AS (SELECT item_id AS query_id, subject, count(*) AS hits FROM benchmark, p WHERE contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), phrase) GROUP BY 1, 2),
b AS (SELECT query_id, max(hits) AS best FROM h GROUP BY 1)
SELECT query_id, CASE WHEN count(subject) = 1 THEN min(subject) END AS subject
FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN (SELECT query_id, subject FROM h JOIN b USING (query_id) WHERE hits = best) USING (query_id) GROUP BY query_id""")
def subject_route(spark, d):
    return routing.route_subject(items(spark, d), routing.phrases(spark, routing.LANGUAGE_PHRASES))


@query("comparison_variants", r"""
WITH m AS (SELECT item_id AS query_id, text, regexp_extract(text, '^(.{8,}?) and (.{8,})$', 1) AS a, regexp_extract(text, '^(.{8,}?) and (.{8,})$', 2) AS b FROM benchmark)
SELECT query_id, 0::BIGINT AS variant_no, CASE WHEN a <> '' THEN trim(a, ' .,?!') ELSE text END AS variant FROM m
UNION ALL SELECT query_id, 1, trim(b, ' .,?!') FROM m WHERE a <> ''""")
def comparison_variants(spark, d):
    return routing.comparison_variants(items(spark, d), r"^(.{8,}?) and (.{8,})$")


@query("planned_rerank", rf"""
WITH {sql.ITEMS}, m AS (SELECT query_id, text, regexp_extract(text, '^(.{{8,}}?) and (.{{8,}})$', 1) AS a, regexp_extract(text, '^(.{{8,}}?) and (.{{8,}})$', 2) AS b FROM items),
v AS (SELECT query_id * 2 AS query_id, CASE WHEN a <> '' THEN trim(a, ' .,?!') ELSE text END AS text FROM m UNION ALL SELECT query_id * 2 + 1, trim(b, ' .,?!') FROM m WHERE a <> ''),
{sql.bm25('v', 'documents', 12, 'lex')},
r AS (SELECT query_id // 2 AS query_id, query_id % 2 AS l, doc_id, rank FROM lex),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, l) AS n FROM r) WHERE n = 1),
c AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, l) AS k FROM u) WHERE k <= 12),
p AS (SELECT c.query_id, c.doc_id, list_distinct({sql.tok('i.text')}) AS q, list_distinct({sql.tok('x.text')}) AS t FROM c JOIN items i USING (query_id) JOIN documents x USING (doc_id)),
s AS (SELECT query_id, doc_id, round(len(list_intersect(q, t))::DOUBLE / len(q), 6) AS score FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def planned_rerank(spark, d):
    """Each variant searched, the lists interleaved, reranked by the original question."""
    variants = routing.comparison_variants(items(spark, d), r"^(.{8,}?) and (.{8,})$")
    asked = variants.select((F.col("query_id") * 2 + F.col("variant_no")).alias("query_id"), F.col("variant").alias("text"))
    found = lexical.bm25(table(spark, d, "documents"), asked, 12)
    lists = [found.where(F.col("query_id") % 2 == n).withColumn("query_id", F.floor(F.col("query_id") / 2)) for n in (0, 1)]
    return fusion.rerank(fusion.round_robin(lists, 12), items(spark, d), table(spark, d, "documents"), 5)


@query("context_needed", r"""
SELECT conv_id, turn, (contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), ' it ') OR contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), ' that ') OR contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), ' this ') OR len(regexp_extract_all(text, '[\p{L}\p{N}]+')) <= 4) AS needs_context
FROM conversations WHERE role = 'user'""")
def context_needed(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", routing.needs_context(F.col("text")).alias("needs_context"))


@query("rewrite_identity", r"SELECT item_id AS query_id, trim(regexp_replace(text, '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ') AS rewritten FROM benchmark")
def rewrite_identity(spark, d):
    return items(spark, d).select("query_id", collapse(F.col("text")).alias("rewritten"))


@query("refusal_rows", f"""{GATED} SELECT query_id, 'refused' AS status, CASE WHEN best >= 15 THEN 'refuse_insufficient' ELSE 'refuse_out_of_domain' END AS reason, 0::BIGINT AS n_citations FROM b WHERE best IS NULL OR best < 40""")
def refusal_rows(spark, d):
    return routing.refusals(fusion.gate(lexical_lane(spark, d, SHOWN), items(spark, d), 40, 15, rewritten=True))


@query("tool_route", r"""
SELECT conv_id, turn, CASE WHEN contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'page') THEN 'source_page' WHEN contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'cite') OR contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'source') THEN 'citation'
  WHEN contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'relate') OR contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'link') THEN 'graph' WHEN conv_id % 3 = 0 OR contains(trim(regexp_replace(lower(text), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' '), 'across') THEN 'cross_subject' ELSE 'subject' END AS tool
FROM conversations WHERE role = 'user'""")
def tool_route(spark, d):
    subject = F.when(F.col("conv_id") % 3 != 0, F.lit("any"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", routing.route_tool(F.col("text"), subject).alias("tool"))
