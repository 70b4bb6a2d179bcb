"""Curation, integrity and stores over the star schema, conversations, events and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import normalized_question, stable_id, tokens
from corpusloom.operators import curate, stores
from corpusloom.operators.scan import running_sums
from corpusloom.queries import sql
from corpusloom.sources import sinks
from corpusloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("dedup_first", r"""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS k FROM documents) SELECT min(doc_id) AS doc_id FROM k WHERE k <> '' GROUP BY k""")
def dedup_first(spark, d):
    key = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return curate.first_of_key(table(spark, d, "documents").select("doc_id", "text"), key, "doc_id").select("doc_id")


@query("question_keys")
def question_keys(spark, d):
    """Accent-free keys: canonical decomposition isn't in either engine."""
    return table(spark, d, "benchmark").select("item_id", normalized_question("text").alias("key"))


@query("near_dup_jaccard", f"""
WITH s AS (SELECT doc_id AS id, list_sort(list_distinct({sql.tok('text')})) AS t FROM documents), g AS (SELECT t, min(id) AS rep FROM s GROUP BY t),
x AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM g a JOIN g b ON a.rep < b.rep AND len(a.t) >= 0.85 * len(b.t) AND len(b.t) >= 0.85 * len(a.t))
SELECT a, b, round(i::DOUBLE / (na + nb - i), 6) AS score FROM x WHERE round(i::DOUBLE / (na + nb - i), 6) >= 0.85
UNION ALL SELECT rep, id, 1.0::DOUBLE FROM s JOIN g USING (t) WHERE id <> rep""")
def near_dup_jaccard(spark, d):
    docs = sinks.spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return curate.near_duplicates(docs.select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("tokens")))


QUOTAS = [("direct", 12), ("explanation", 9), ("comparison", 7), ("synthesis", 5)]


@query("quota_interleave", """
WITH q(category, quota, o) AS (VALUES ('direct', 12, 0), ('explanation', 9, 1), ('comparison', 7, 2), ('synthesis', 5, 3)),
h AS (SELECT CASE quality WHEN 0 THEN 'direct' ELSE 'comparison' END AS category, least(count(*), 4) AS n FROM labels GROUP BY 1),
e AS (SELECT category, o, unnest(range(1, quota - coalesce(n, 0) + 1)) AS i FROM q LEFT JOIN h USING (category))
SELECT row_number() OVER (ORDER BY i, o) AS place, category FROM e""")
def quota_interleave(spark, d):
    have = table(spark, d, "labels").groupBy(F.when(F.col("quality") == 0, "direct").otherwise("comparison").alias("category")).agg(F.least(F.count("*"), F.lit(4)).alias("n"))
    return curate.quota_plan(spark, QUOTAS, have)


@query("stratified_batches", """
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS depth FROM documents WHERE n_chars >= 500), p AS (SELECT doc_id, source, row_number() OVER (ORDER BY depth, source) AS place FROM d)
SELECT doc_id, source, place, (place - 1) // 8 AS batch_no FROM p WHERE place <= 100""")
def stratified_batches(spark, d):
    return curate.stratified_batches(table(spark, d, "documents").where("n_chars >= 500").select("doc_id", "source"), "source", "doc_id", 100, 8)


@query("balanced_selection")
def balanced_selection(spark, d):
    return curate.balanced_selection(table(spark, d, "documents").select("doc_id", "source", "lang"), 60, "doc_id", ("source", "lang"))


@query("perturbations", """
WITH b AS (SELECT item_id, text, lead(text, 1, (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)) OVER (ORDER BY item_id) AS other FROM benchmark)
SELECT item_id, unnest(['sufficient', 'partial', 'missing', 'wrong_aspect']) AS perturbation, unnest([text, substr(text, 1, length(text) // 2), '', other]) AS context FROM b""")
def perturbations(spark, d):
    """Each question with its whole text, half of it, none, and another's."""
    b = table(spark, d, "benchmark")
    first = b.agg(F.min_by("text", "item_id").alias("first"))
    place = running_sums(b.select("item_id", F.lit(1).alias("one")), "item_id", {"n": "one"}).select("item_id", "n")
    following = place.select((F.col("n") - 1).alias("n"), F.col("item_id").alias("then")).join(b.select(F.col("item_id").alias("then"), F.col("text").alias("next")), "then")
    rows = b.join(place, "item_id").join(following.select("n", "next"), "n", "left").join(F.broadcast(first)).withColumn("other", F.coalesce("next", "first"))  # one row
    case = lambda n, c: F.struct(F.lit(n).alias("perturbation"), c.alias("context"))
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return rows.select("item_id", F.explode(F.array(case("sufficient", F.col("text")), case("partial", half), case("missing", F.lit("")), case("wrong_aspect", F.col("other")))).alias("x")).select("item_id", "x.*")


@query("portfolio_warnings", f"""
WITH b AS (SELECT doc_id, source, lang, {sql.tok('text')} AS t, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words FROM documents),
u AS (SELECT lang, count(*) AS uses, (SELECT count(*) FROM documents) AS n FROM documents GROUP BY 1)
SELECT 'length' AS warning, doc_id::VARCHAR AS id FROM b WHERE words NOT BETWEEN 5 AND 250
UNION ALL SELECT 'overuse', lang FROM u WHERE uses > greatest(3, ceil(n * 0.25::DOUBLE))
UNION ALL SELECT 'quota', source FROM documents GROUP BY source HAVING count(*) > 40""")
def portfolio_warnings(spark, d):
    docs = table(spark, d, "documents")
    words = F.size(F.filter(F.split("text", " ", -1), lambda w: w != ""))
    length = docs.where(~words.between(5, 250)).select(F.lit("length").alias("warning"), F.col("doc_id").cast("string").alias("id"))
    over = curate.overused(docs.select("lang"), "lang").select(F.lit("overuse").alias("warning"), F.col("lang").alias("id"))
    quota = docs.groupBy("source").count().where("count > 40").select(F.lit("quota").alias("warning"), F.col("source").alias("id"))
    return length.unionByName(over).unionByName(quota)


@query("overuse_counts", "SELECT p_brand, uses FROM (SELECT p_brand, count(*) AS uses FROM part GROUP BY 1), (SELECT count(*) AS n FROM part) WHERE uses > greatest(3, ceil(n * 0.03::DOUBLE))")
def overuse_counts(spark, d):
    return curate.overused(table(spark, d, "part").select("p_brand"), "p_brand", share=0.03)


@query("leakage_check", "SELECT l_partkey, count(DISTINCT l_orderkey % 2) AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 2) > 1")
def leakage_check(spark, d):
    return curate.leakage(table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") % 2).alias("split")), "l_partkey")


@query("component_split")
def component_split(spark, d):
    """Benchmark items that documents share stay together; the two sizes stay distributed."""
    from corpusloom.operators.evaluate import containment

    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    parents = containment(table(spark, d, "documents"), items)
    rows = items.withColumn("size", F.when(F.length("text") < 200, "short").otherwise("long")).join(parents, "query_id", "left").select("query_id", "size", "doc_id")
    return curate.component_split(rows, "query_id", "doc_id", int(items.count() * 0.3), ["size"], "fixed")


@query("replacement_pool", """
WITH u AS (SELECT l_suppkey, count(*) AS uses FROM lineitem GROUP BY 1), r AS (SELECT s_suppkey, s_nationkey, coalesce(uses, 0) AS uses, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(uses, 0), s_suppkey) - 1 AS n, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier LEFT JOIN u ON l_suppkey = s_suppkey)
SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, uses, (n + s_nationkey) % size AS place FROM r WHERE (n + s_nationkey) % size < 3""")
def replacement_pool(spark, d):
    """The least used of each group first, rotated by the group's offset."""
    uses = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("uses"))
    rows = table(spark, d, "supplier").join(uses, "s_suppkey", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    w = W.partitionBy("s_nationkey")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("uses", "s_suppkey")) - 1).withColumn("size", F.count("*").over(w))
    place = (F.col("n") + F.col("s_nationkey")) % F.col("size")
    return rows.select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), "uses", place.alias("place")).where("place < 3")


@query("select_sources", """
WITH g AS (SELECT o_orderkey, o_orderpriority, count(DISTINCT l_suppkey) AS groups FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2)
SELECT o_orderpriority, o_orderkey, groups, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY groups DESC, o_orderkey) AS n FROM g) WHERE n <= 8""")
def select_sources(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("groups")).where("groups >= 2")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey")
    n = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("groups"), "o_orderkey"))
    return rows.withColumn("place", n.cast("long")).where("place <= 8")


@query("review_import", """
WITH d AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de'), r AS (SELECT doc_id, CASE WHEN source IN ('src3', 'src5') THEN 1 - quality ELSE quality END AS quality, CASE WHEN toxic = 1 AND quality = 0 THEN 'maybe' WHEN quality = 0 THEN 'reject' ELSE 'accept' END AS decision FROM labels JOIN documents USING (doc_id) WHERE lang <> 'es')
SELECT CASE WHEN r.doc_id IS NULL THEN 'missing_review' WHEN d.doc_id IS NULL THEN 'unknown_id' WHEN d.quality <> r.quality THEN 'changed' WHEN decision = 'maybe' THEN 'bad_decision' END AS issue, coalesce(d.doc_id, r.doc_id) AS id
FROM d FULL JOIN r ON d.doc_id = r.doc_id WHERE r.doc_id IS NULL OR d.doc_id IS NULL OR d.quality <> r.quality OR decision = 'maybe'""")
def review_import(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    quality, toxic = F.col("quality"), F.col("toxic")
    review = rows.where("lang <> 'es'").select("doc_id", F.when(F.col("source").isin("src3", "src5"), 1 - quality).otherwise(quality).alias("quality"), F.when((toxic == 1) & (quality == 0), "maybe").when(quality == 0, "reject").otherwise("accept").alias("decision"))
    return curate.review_issues(rows.where("lang <> 'de'"), review, "doc_id", ["quality"], ("accept", "reject"))


@query("review_counts", "SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'accept' WHEN quality = 0 THEN 'reject' ELSE 'revise' END AS decision, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def review_counts(spark, d):
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("quality") == 0, "reject").otherwise("revise")
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("draft_filter", """
SELECT doc_id FROM documents d WHERE lang <> 'es' AND source NOT IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def draft_filter(spark, d):
    docs = table(spark, d, "documents").where("lang <> 'es' and source not in ('src1', 'src2')").select("doc_id")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


@query("gold_groups", """
WITH u AS (SELECT l_orderkey AS question_id, l_suppkey % 7 AS parent_id, l_partkey % 50 AS page FROM lineitem)
SELECT question_id, array_to_string(list_sort(list_distinct(list(parent_id))), ',') AS parents, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM u GROUP BY 1""")
def gold_groups(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return rows.agg(joined(F.col("l_suppkey") % 7).alias("parents"), joined(F.col("l_partkey") % 50).alias("pages"))


@query("reasoning_scope", "SELECT o_orderkey, CASE WHEN n = 1 THEN 'single_chunk' WHEN s = 1 THEN 'single_parent' ELSE 'multi_parent' END AS scope FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)")
def reasoning_scope(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s"))
    return rows.select("o_orderkey", F.when(F.col("n") == 1, "single_chunk").when(F.col("s") == 1, "single_parent").otherwise("multi_parent").alias("scope"))


@query("review_pack", "SELECT conv_id, string_agg(turn || ' ' || role || ': ' || substr(text, 1, 40), ' | ' ORDER BY turn, role, text) AS pack FROM conversations GROUP BY 1")
def review_pack(spark, d):
    part = F.concat(F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit(": "), F.substring("text", 1, 40))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", part.alias("p")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda v: v["p"]), " | ").alias("pack"))


@query("gold_patches", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END::INTEGER AS quality, toxic FROM labels")
def gold_patches(spark, d):
    rows = table(spark, d, "labels")
    return curate.patched(rows, rows.where("toxic = 1").select("doc_id", F.lit(0).alias("quality")), "doc_id", ["quality"])


@query("reject_batches", "WITH r AS (SELECT doc_id // 10 AS batch, doc_id FROM labels) SELECT batch, doc_id FROM r WHERE batch NOT IN (SELECT batch FROM r WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))")
def reject_batches(spark, d):
    rows = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 10).alias("batch"), "doc_id")
    return curate.reject_batches(rows, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "batch", "doc_id")


@query("split_distribution", """
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source, 'all') AS value, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def split_distribution(spark, d):
    each = F.explode(F.array(F.struct(F.lit("lang").alias("dimension"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value")), F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))))
    return table(spark, d, "documents").select("n_chars", each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


# -- integrity ------------------------------------------------------------------------------------------------


@query("stable_ids", "SELECT doc_id, 'doc_' || substr(sha256(source || chr(10) || lang || chr(10) || text), 1, 16) AS stable_id FROM documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", stable_id("doc", F.col("source"), F.col("lang"), F.col("text")).alias("stable_id"))


@query("table_manifest")
def table_manifest(spark, d):
    """Rows and a digest that no order or partitioning changes."""
    names = ("documents", "labels", "benchmark", "conversations")
    return reduce(DataFrame.unionByName, [sinks.content_hash(table(spark, d, n)).select(F.lit(n).alias("name"), "rows", "digest") for n in names])


@query("config_digest", """SELECT c_custkey, sha256('{"balance":' || round(c_acctbal)::BIGINT || ',"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS digest FROM customer""")
def config_digest(spark, d):
    row = F.to_json(F.struct(F.round("c_acctbal").cast("long").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")))
    return table(spark, d, "customer").select("c_custkey", F.sha2(row, 256).alias("digest"))


@query("referential_checks", """
SELECT 'unknown_supplier' AS issue, l_suppkey::VARCHAR AS id FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
UNION ALL SELECT 'unknown_order', l_orderkey::VARCHAR FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
UNION ALL SELECT 'unknown_customer', o_custkey::VARCHAR FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'repeated_line', k::VARCHAR FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def referential_checks(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    found = [
        stores.referential(lines, "l_suppkey", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey", "unknown_supplier"),
        stores.referential(lines, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey", "unknown_order"),
        stores.referential(orders, "o_custkey", table(spark, d, "customer"), "c_custkey", "unknown_customer"),
        stores.repeated(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "k", "repeated_line"),
    ]
    return reduce(DataFrame.unionByName, found)


@query("stale_checks", "SELECT doc_id, sha256(text) <> sha256(CASE WHEN lang = 'fr' THEN upper(replace(text, 'ß', 'ss')) ELSE text END) AS stale FROM documents")
def stale_checks(spark, d):
    expected = F.sha2(F.when(F.col("lang") == "fr", F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).otherwise(F.col("text")), 256)
    return table(spark, d, "documents").select("doc_id", (F.sha2("text", 256) != expected).alias("stale"))


@query("subject_audit", """
WITH a AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE length(text) = n_chars) AS sized, count(*) FILTER (WHERE trim(text, ' ') = '') AS empty, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents)
SELECT unnest(['rows', 'unique_ids', 'sizes', 'no_empty', 'four_languages', 'sources', 'unique_texts']) AS "check", unnest([n > 0, n = ids, n = sized, empty = 0, langs = 4, sources = 20, n = texts]) AS passed FROM a""")
def subject_audit(spark, d):
    n = F.count("*")
    return stores.checks(
        {
            "rows": n > 0,
            "unique_ids": n == F.countDistinct("doc_id"),
            "sizes": n == F.count_if(F.length("text") == F.col("n_chars")),
            "no_empty": F.count_if(F.trim("text") == "") == 0,
            "four_languages": F.countDistinct("lang") == 4,
            "sources": F.countDistinct("source") == 20,
            "unique_texts": n == F.countDistinct(F.sha2("text", 256)),
        },
        table(spark, d, "documents"),
    )


@query("mapping_coverage", "SELECT 'missing' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT 'extra', count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)")
def mapping_coverage(spark, d):
    docs, vecs = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    both = docs.withColumn("a", F.lit(True)).join(vecs.withColumn("b", F.lit(True)), "id", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra")).select(F.explode(F.array(F.struct(F.lit("missing").alias("side"), F.col("missing").alias("n")), F.struct(F.lit("extra").alias("side"), F.col("extra").alias("n")))).alias("x")).select("x.*")


@query("artifact_stats", "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS pages, min(l_quantity) AS least, max(l_quantity) AS most, count(*) FILTER (WHERE l_tax = 0) AS untaxed, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem")
def artifact_stats(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("pages"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


_RECT = "SELECT {} AS id, l_partkey AS page, (l_suppkey % 10) * 10.0::DOUBLE AS x0, (l_linenumber * 10)::DOUBLE AS y0, (l_suppkey % 10) * 10.0::DOUBLE + l_quantity AS x1, (l_linenumber * 10)::DOUBLE + 15 AS y1 FROM lineitem WHERE {}"


@query("span_overlap", f"""
WITH e AS ({_RECT.format('l_orderkey * 1000 + l_suppkey * 10 + l_linenumber', "l_returnflag = 'R'")}), c AS ({_RECT.format('l_orderkey * 100000 + l_partkey', "l_returnflag = 'A'")}),
s AS (SELECT e.id AS evidence_id, c.id AS chunk_id, round(greatest(least(e.x1, c.x1) - greatest(e.x0, c.x0), 0) * greatest(least(e.y1, c.y1) - greatest(e.y0, c.y0), 0) / nullif((e.x1 - e.x0) * (e.y1 - e.y0), 0), 6) AS score FROM (SELECT DISTINCT ON (id) * FROM e ORDER BY id, page, x0, y0, x1) e JOIN (SELECT DISTINCT ON (id) * FROM c ORDER BY id, page, x0, y0, x1) c USING (page)),
r AS (SELECT *, max(score) OVER (PARTITION BY evidence_id) AS best, row_number() OVER (PARTITION BY evidence_id ORDER BY score DESC, chunk_id) AS n FROM s WHERE score > 0)
SELECT evidence_id, chunk_id, score, n = 1 AS "primary" FROM r WHERE n = 1 OR score >= greatest(0.5, best * 0.75)""")
def span_overlap(spark, d):
    """Rectangles on pages, made of line items."""
    rows = table(spark, d, "lineitem")
    x, y = (F.col("l_suppkey") % 10) * 10.0, (F.col("l_linenumber") * 10).cast("double")

    def rects(id_, name, where):
        out = rows.where(where).select(id_.alias(name), F.col("l_partkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 15).alias("y1"))
        return out.withColumn("n", F.row_number().over(W.partitionBy(name).orderBy("page", "x0", "y0", "x1"))).where("n = 1").drop("n")

    evidence = rects(F.col("l_orderkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"), "evidence_id", "l_returnflag = 'R'")
    return stores.span_matches(evidence, rects(F.col("l_orderkey") * 100000 + F.col("l_partkey"), "chunk_id", "l_returnflag = 'A'"))


@query("anchor_repair", """
WITH b AS (SELECT s_nationkey AS page, 'p' || s_nationkey || '_b' || s_suppkey AS block_id FROM supplier), a AS (SELECT s_nationkey AS page, CASE s_suppkey % 3 WHEN 0 THEN 'p' || s_nationkey || '_b' || s_suppkey WHEN 1 THEN '_b' || s_suppkey ELSE 'p' || s_nationkey END AS anchor FROM supplier),
x AS (SELECT DISTINCT page, anchor FROM a)
SELECT page::BIGINT AS page, anchor, coalesce(max(block_id) FILTER (WHERE block_id = anchor), CASE WHEN count(*) FILTER (WHERE block_id <> anchor AND (starts_with(block_id, anchor) OR ends_with(block_id, anchor))) = 1 THEN max(block_id) FILTER (WHERE block_id <> anchor AND (starts_with(block_id, anchor) OR ends_with(block_id, anchor))) END) AS block_id
FROM x JOIN b USING (page) GROUP BY 1, 2""")
def anchor_repair(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey is not null").withColumn("page", F.col("s_nationkey").cast("long"))
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("s_suppkey").cast("string"))
    anchor = F.when(F.col("s_suppkey") % 3 == 0, name).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("_b"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("page").cast("string")))
    return stores.anchors_repaired(s.select("page", anchor.alias("anchor")).distinct(), s.select("page", name.alias("block_id")))


@query("structure_alignment", """
WITH e AS (SELECT o_orderkey AS page, o_custkey % 4 AS level FROM orders), h AS (SELECT l_orderkey AS page, l_suppkey % 4 AS level FROM lineitem WHERE l_linenumber <= 2 AND l_linestatus = 'F')
SELECT status, count(*) AS n FROM (SELECT e.page, e.level, CASE WHEN count(h.page) = 0 THEN 'unmatched' WHEN bool_or(h.level = e.level) THEN 'match' ELSE 'mismatch' END AS status FROM e LEFT JOIN h USING (page) GROUP BY 1, 2) GROUP BY 1""")
def structure_alignment(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 4).alias("level"))
    h = table(spark, d, "lineitem").where("l_linenumber <= 2 and l_linestatus = 'F'").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 4).alias("found"))
    both = e.join(h, "page", "left").groupBy("page", "level").agg(F.count("found").alias("n"), F.bool_or(F.col("found") == F.col("level")).alias("same"))
    return both.groupBy(F.when(F.col("n") == 0, "unmatched").when(F.col("same"), "match").otherwise("mismatch").alias("status")).agg(F.count("*").alias("n"))


@query("gold_remap", """
WITH a AS (SELECT DISTINCT l_partkey, l_quantity, l_orderkey AS old FROM lineitem), b AS (SELECT DISTINCT l_partkey, l_quantity, l_orderkey // 10 AS new FROM lineitem)
SELECT old, array_to_string(list_sort(list_distinct(list(new))), ',') AS new_ids FROM a JOIN b USING (l_partkey, l_quantity) GROUP BY 1""")
def gold_remap(spark, d):
    """Chunks of one cutting to those of another with an equal span key."""
    rows = table(spark, d, "lineitem")
    a = rows.select("l_partkey", "l_quantity", F.col("l_orderkey").alias("old")).distinct()
    b = rows.select("l_partkey", "l_quantity", F.floor(F.col("l_orderkey") / 10).alias("new")).distinct()
    return a.join(b, ["l_partkey", "l_quantity"]).groupBy("old").agg(F.array_join(F.transform(F.sort_array(F.collect_set("new")), lambda x: x.cast("string")), ",").alias("new_ids"))


@query("page_coverage", """
SELECT p.page_id, count(h.doc_id) AS headings, bool_or(h.doc_id IS NOT NULL) AS covered FROM pages p LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id FROM labels) h ON h.doc_id = p.page_id GROUP BY 1""")
def page_coverage(spark, d):
    """Pages beside what covers them: a flag and a count, zero where there is none."""
    h = table(spark, d, "documents").where("n_chars > 1000").select("doc_id").unionByName(table(spark, d, "labels").select("doc_id"))
    counts = h.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))
    return table(spark, d, "pages").select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("headings"), F.col("n").isNotNull().alias("covered"))


# -- stores ---------------------------------------------------------------------------------------------------


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    return sinks.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("merge_delete", "SELECT event_id, CASE WHEN event_type = 'login' THEN -1.0::DOUBLE ELSE value END AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT 10000000 + event_id, 0 FROM events WHERE event_type = 'signup'")
def merge_delete(spark, d):
    """Logins are replaced, sign-ups come again under new ids, errors go."""
    rows = table(spark, d, "events").select("event_id", "value", "event_type")
    new = rows.where("event_type = 'login'").select("event_id", F.lit(-1.0).alias("value")).unionByName(rows.where("event_type = 'signup'").select((F.col("event_id") + 10000000).alias("event_id"), F.lit(0.0).alias("value")))
    return sinks.merged(rows.drop("event_type"), new, ["event_id"], delete=rows.where("event_type = 'error'"))


@query("chunk_spans", "SELECT conv_id AS chunk_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) AS span_no, length(text)::BIGINT AS size FROM conversations")
def chunk_spans(spark, d):
    """Spans are replaced as a whole; their number is their place."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("spans"))
    return rows.select("chunk_id", F.posexplode("spans").alias("span_no", "s")).select("chunk_id", F.col("span_no").cast("long").alias("span_no"), F.length("s.text").cast("long").alias("size"))


@query("feedback_idempotent", "SELECT 'feedback_' || substr(sha256(user_id || chr(10) || event_type), 1, 16) AS feedback_id, max(value) AS value FROM events GROUP BY user_id, event_type")
def feedback_idempotent(spark, d):
    rows = table(spark, d, "events").select(stable_id("feedback", F.col("user_id"), F.col("event_type")).alias("feedback_id"), "value")
    return rows.groupBy("feedback_id").agg(F.max("value").alias("value"))


@query("recent_context", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def recent_context(spark, d):
    return stores.recent(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "place")


@query("preceding_turns", "SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def preceding_turns(spark, d):
    return stores.preceding(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("conversation_titles", """
SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'user') > 0 THEN CASE WHEN length(arg_min(text, turn) FILTER (WHERE role = 'user')) > 60 THEN substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 60) || '…' ELSE arg_min(text, turn) FILTER (WHERE role = 'user') END END AS title, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY 1""")
def conversation_titles(spark, d):
    return stores.titles(table(spark, d, "conversations"), "conv_id", "turn")


@query("conversation_list", "SELECT conv_id, messages, last, row_number() OVER (ORDER BY last DESC, conv_id DESC) AS place FROM (SELECT conv_id, count(*) AS messages, max(turn) AS last FROM conversations GROUP BY 1) ORDER BY place LIMIT 50")
def conversation_list(spark, d):
    """The fifty latest: a list that a user sees."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last")).orderBy(F.desc("last"), F.desc("conv_id")).limit(50)
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("last"), F.desc("conv_id"))).cast("long"))


@query("conversation_delete", "SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1")
def conversation_delete(spark, d):
    rows = table(spark, d, "conversations")
    left = stores.without({"messages": rows}, rows.where("role = 'system'").select("conv_id").distinct(), "conv_id")["messages"]
    return left.groupBy("conv_id").agg(F.count("*").alias("messages"))


@query("tool_budget", "SELECT event_id, n AS call_no, CASE WHEN n > 5 THEN 'budget_exceeded' WHEN event_type = 'error' THEN 'tool_error' ELSE 'ok' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def tool_budget(spark, d):
    calls = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return stores.budgeted(calls, "user_id", "event_id", 5).select("event_id", "call_no", "status")


@query("session_auth", "SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'signup' AND ts + INTERVAL 20 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def session_auth(spark, d):
    logins = table(spark, d, "events").where("event_type = 'signup'").select("event_id", "user_id", (F.col("ts") + F.expr("interval 20 days")).alias("expires_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return stores.sessions(logins, users, F.expr("timestamp '2024-01-20 00:00:00'")).select("event_id", "c_name")


@query("account_memory", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE value > 480)")
def account_memory(spark, d):
    """An account's entries by time; cleared accounts have none."""
    rows = table(spark, d, "events")
    kept = stores.without({"memory": rows.where("event_type = 'signup'")}, rows.where("value > 480").select("user_id").distinct(), "user_id")["memory"]
    return kept.select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("json_props", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("citation_verify", """
WITH s AS (SELECT o_orderkey AS evidence_id, list(l_partkey % 20) AS spans FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' GROUP BY 1), c AS (SELECT o_orderkey AS citation_id, o_orderkey AS evidence_id, o_custkey % 20 AS span FROM orders)
SELECT citation_id, CASE WHEN spans IS NULL THEN 'unknown_evidence' WHEN list_contains(spans, span) THEN 'ok' ELSE 'unknown_span' END AS status FROM c LEFT JOIN s USING (evidence_id)""")
def citation_verify(spark, d):
    evidence = table(spark, d, "lineitem").where("l_returnflag <> 'A'").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.collect_list(F.col("l_partkey") % 20).alias("spans"))
    cited = table(spark, d, "orders").select(F.col("o_orderkey").alias("citation_id"), F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") % 20).alias("span"))
    return stores.verify_citations(cited, evidence)


@query("citation_dedup", "SELECT event_id AS citation_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS canonical_id FROM events")
def citation_dedup(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("citation_id"), "user_id", "event_type")
    return stores.canonical_citations(rows, ["user_id", "event_type"], "citation_id")


@query("answer_materialise", """
WITH c AS (SELECT o_orderkey AS claim_id, unnest([o_custkey % 5, o_custkey % 3, o_custkey % 5]) AS evidence_id, unnest([0, 1, 2]) AS pos FROM orders), f AS (SELECT claim_id, evidence_id, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT claim_id, string_agg(r_name, ',' ORDER BY pos) AS evidence FROM f JOIN region ON r_regionkey = evidence_id GROUP BY 1""")
def answer_materialise(spark, d):
    """Claims with their evidence, each once, in the order first named."""
    k = F.col("o_custkey")
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.posexplode(F.array(k % 5, k % 3, k % 5)).alias("pos", "evidence_id"))
    first = claims.groupBy("claim_id", "evidence_id").agg(F.min("pos").alias("pos"))
    named = first.join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("evidence_id"))  # a dimension of five rows
    return named.groupBy("claim_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "r_name"))), lambda x: x["r_name"]), ",").alias("evidence"))


@query("citation_first_span", """
WITH s AS (SELECT l_orderkey AS evidence_id, l_suppkey % 4 AS page, min(l_partkey) AS span FROM lineitem GROUP BY 1, 2) SELECT o_orderkey AS citation_id, span FROM orders LEFT JOIN s ON evidence_id = o_orderkey AND page = o_custkey % 4""")
def citation_first_span(spark, d):
    """A citation gets the first span that its evidence has on its page."""
    spans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("citation_id"), (F.col("l_suppkey") % 4).alias("page")).agg(F.min("l_partkey").alias("span"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("citation_id"), (F.col("o_custkey") % 4).alias("page")).join(spans, ["citation_id", "page"], "left").select("citation_id", "span")


@query("coverage_all", """
SELECT o_orderkey, bool_and(l.parents IS NOT NULL AND list_contains(l.parents, a)) AS complete FROM (SELECT o_orderkey, unnest([o_custkey % 3, o_custkey % 2]) AS a FROM orders)
LEFT JOIN (SELECT l_orderkey, list(l_suppkey % 3) AS parents FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage_all(spark, d):
    """Whether every aspect of a question is among its retrieved parents."""
    parents = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_suppkey") % 3).alias("parents"))
    need = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 3, F.col("o_custkey") % 2).alias("need"))
    both = need.join(parents, "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce(F.forall("need", lambda a: F.array_contains("parents", a)), F.lit(False)).alias("complete"))


@query("targeted_recovery", """
WITH a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'purchase') AS mended, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1)
SELECT count(*) AS cases, count(*) FILTER (WHERE failures > 0) AS activated, count(*) FILTER (WHERE failures > 0 AND mended > failures) AS recovered, round(count(*) FILTER (WHERE failures > 0 AND mended > failures)::DOUBLE / nullif(count(*) FILTER (WHERE failures > 0), 0), 6) AS rate, round(median(p50), 6) AS latency FROM a""")
def targeted_recovery(spark, d):
    kind = F.col("event_type")
    by = table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("failures"), F.count_if(kind == "purchase").alias("mended"), F.percentile("value", 0.5).alias("p50"))
    active, ok = F.col("failures") > 0, (F.col("failures") > 0) & (F.col("mended") > F.col("failures"))
    return by.agg(F.count("*").alias("cases"), F.count_if(active).alias("activated"), F.count_if(ok).alias("recovered"), F.round(F.count_if(ok) / F.nullif(F.count_if(active), F.lit(0)), 6).alias("rate"), F.round(F.median("p50"), 6).alias("latency"))
