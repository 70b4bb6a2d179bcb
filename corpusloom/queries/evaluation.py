"""Evaluation: gold by containment of benchmark texts, systems compared by question, classifiers against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import content_tokens, coverage, tokens
from corpusloom.operators import evaluate as ev
from corpusloom.operators import fusion, graph
from corpusloom.queries import sql
from corpusloom.queries.retrieval import dense_lane, items, lexical_lane
from corpusloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


GOLD = """gold AS (SELECT query_id, lang AS group_id, doc_id, CASE WHEN row_number() OVER (PARTITION BY query_id, lang ORDER BY doc_id) = 1 THEN 2 ELSE 1 END AS grade, lang <> 'es' AS required
  FROM items i JOIN documents d ON contains(d.text, i.text))"""


def gold(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    found = ev.containment(docs, items(spark, d)).join(docs.select("doc_id", "lang"), "doc_id")
    first = F.row_number().over(W.partitionBy("query_id", "lang").orderBy("doc_id")) == 1
    return found.select("query_id", F.col("lang").alias("group_id"), "doc_id", F.when(first, 2).otherwise(1).alias("grade"), (F.col("lang") != "es").alias("required"))


def hybrid(spark, d, lex=None):
    return fusion.reciprocal_rank_fusion([lexical_lane(spark, d) if lex is None else lex, dense_lane(spark, d)], 10)


LANES = f"{sql.ITEMS}, {sql.VECTORS}, {sql.bm25('items', 'documents', 30, 'lex')}, {sql.cosine('vectors', 30, 'den')}, {sql.rrf(['lex', 'den'], 10, 'hyb')}, {GOLD}"


def _per(ranking: str, name: str) -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE required AND rank <= {n}) AS hit_{n}" for n in ev.KS)
    return f"""
{name}_h AS (SELECT g.*, r.rank FROM gold g LEFT JOIN {ranking} r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.rank <= 10),
{name}_g AS (SELECT query_id, group_id, required, min(rank) AS rank FROM {name}_h GROUP BY 1, 2, 3),
{name}_q AS (SELECT query_id, count(*) FILTER (WHERE required) AS groups, min(rank) FILTER (WHERE required) AS first_rank, {hits} FROM {name}_g GROUP BY 1),
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM (SELECT query_id, doc_id, max(grade) AS grade, min(rank) AS rank FROM {name}_h GROUP BY 1, 2)),
{name}_n AS (SELECT query_id, coalesce(sum(grade / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg, sum(grade / log2(place + 1)) FILTER (WHERE place <= 5) AS ideal,
  coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg_binary, sum(1 / log2(place + 1)) FILTER (WHERE place <= 5) AS ideal_binary FROM {name}_d GROUP BY 1),
{name} AS (SELECT *, hit_5 = groups AS full_5, hit_10 = groups AS full_10 FROM {name}_q JOIN {name}_n USING (query_id) WHERE groups > 0)"""


_METRICS = ", ".join(
    ["count(*) AS questions"]
    + [f"round(avg(CASE WHEN first_rank <= {n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{n}" for n in ev.KS]
    + ["round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr", "round(avg(dcg / ideal), 6) AS ndcg_5"]
    + [f"round(sum(hit_{n})::DOUBLE / sum(groups), 6) AS group_recall_{n}" for n in ev.KS]
    + ["round(avg(hit_5::DOUBLE / groups), 6) AS coverage_5", "round(avg(full_5::INT::DOUBLE), 6) AS full_5", "round(avg(full_10::INT::DOUBLE), 6) AS full_10"]
)


@query("gold_containment", f"WITH {sql.ITEMS}, {GOLD} SELECT query_id, group_id, doc_id, grade::INTEGER AS grade, required FROM gold")
def gold_containment(spark, d):
    return gold(spark, d)


@query("retrieval_metrics", f"WITH {LANES}, {_per('lex', 'p')} SELECT {_METRICS} FROM p")
def retrieval_metrics(spark, d):
    return ev.metrics(ev.by_query(gold(spark, d), lexical_lane(spark, d, 10)))


@query("retrieval_by_question", f"WITH {LANES}, {_per('hyb', 'p')} SELECT query_id, groups, first_rank, hit_1, hit_5, hit_10, full_5, full_10 FROM p")
def retrieval_by_question(spark, d):
    return ev.by_query(gold(spark, d), hybrid(spark, d)).select("query_id", "groups", "first_rank", "hit_1", "hit_5", "hit_10", "full_5", "full_10")


@query("ndcg_variants", f"WITH {LANES}, {_per('hyb', 'p')} SELECT query_id, round(dcg / ideal, 6) AS graded, round(dcg_binary / ideal_binary, 6) AS binary_gain, round(dcg / nullif(greatest(ideal, dcg), 0), 6) AS bounded FROM p")
def ndcg_variants(spark, d):
    per = ev.by_query(gold(spark, d), hybrid(spark, d))
    return per.select("query_id", F.round(F.col("dcg") / F.col("ideal"), 6).alias("graded"), F.round(F.col("dcg_binary") / F.col("ideal_binary"), 6).alias("binary_gain"), F.round(F.col("dcg") / F.greatest("ideal", "dcg"), 6).alias("bounded"))


_DIM = """dims AS (SELECT query_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS size, (query_id % 3)::VARCHAR AS kind, CASE WHEN contains(text, ',') THEN 'commas' ELSE 'plain' END AS style FROM items)"""


def dimensions(spark, d):
    return items(spark, d).select("query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("size"), (F.col("query_id") % 3).cast("string").alias("kind"), F.when(F.contains("text", F.lit(",")), "commas").otherwise("plain").alias("style"))


@query("metric_slices", f"""
WITH {LANES}, {_per('lex', 'p')}, {_DIM}
SELECT CASE WHEN size IS NOT NULL THEN 'size' WHEN kind IS NOT NULL THEN 'kind' ELSE 'style' END AS dimension, coalesce(size, kind, style) AS value, {_METRICS} FROM p JOIN dims USING (query_id) GROUP BY GROUPING SETS ((size), (kind), (style))""")
def metric_slices(spark, d):
    """The metrics over several dimensions, each by itself."""
    per = ev.by_query(gold(spark, d), lexical_lane(spark, d, 10)).join(dimensions(spark, d), "query_id")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("size", "kind", "style")]))
    return ev.metrics(per.withColumn("x", each).select("*", "x.dimension", "x.value"), "dimension", "value")


_OUTCOME = """CASE WHEN NOT a.full_5 AND b.full_5 THEN 'win' WHEN a.full_5 AND NOT b.full_5 THEN 'loss' WHEN a.full_5 THEN CASE WHEN b.first_rank < a.first_rank THEN 'win' WHEN b.first_rank > a.first_rank THEN 'loss' ELSE 'tie' END
 WHEN a.first_rank IS NULL AND b.first_rank IS NOT NULL THEN 'mixed' WHEN a.first_rank IS NOT NULL AND b.first_rank IS NULL THEN 'loss' ELSE 'tie' END"""


@query("transition_outcome", f"WITH {LANES}, {_per('den', 'a')}, {_per('hyb', 'b')} SELECT query_id, {_OUTCOME} AS outcome FROM a JOIN b USING (query_id)")
def transition_outcome(spark, d):
    g = gold(spark, d)
    return ev.transitions(ev.by_query(g, dense_lane(spark, d)), ev.by_query(g, hybrid(spark, d)))


@query("transition_counts", f"WITH {LANES}, {_per('den', 'a')}, {_per('hyb', 'b')} SELECT {_OUTCOME} AS outcome, count(*) AS questions FROM a JOIN b USING (query_id) GROUP BY 1")
def transition_counts(spark, d):
    return transition_outcome(spark, d).groupBy("outcome").agg(F.count("*").alias("questions"))


@query("acceptance_gate", f"""
WITH {LANES}, {_per('den', 'a')}, {_per('hyb', 'b')}, o AS (SELECT {_OUTCOME} AS o FROM a JOIN b USING (query_id))
SELECT count(*) FILTER (WHERE o = 'win') AS wins, count(*) FILTER (WHERE o = 'loss') AS losses, count(*) FILTER (WHERE o = 'win') > count(*) FILTER (WHERE o = 'loss') AND count(*) FILTER (WHERE o = 'loss') <= 1 AS accepted FROM o""")
def acceptance_gate(spark, d):
    """More wins than losses, and one loss at most."""
    wins, losses = F.count_if(F.col("outcome") == "win"), F.count_if(F.col("outcome") == "loss")
    return transition_outcome(spark, d).agg(wins.alias("wins"), losses.alias("losses"), ((wins > losses) & (losses <= 1)).alias("accepted"))


@query("rank_deltas", f"""
WITH {LANES}, {_per('den', 'a')}, {_per('hyb', 'b')}, x AS (SELECT query_id, coalesce(a.first_rank, 11) - coalesce(b.first_rank, 11) AS rank_delta, b.hit_5 - a.hit_5 AS group_delta FROM a JOIN b USING (query_id))
SELECT *, CASE WHEN (rank_delta > 0 OR group_delta > 0) AND (rank_delta < 0 OR group_delta < 0) THEN 'mixed' WHEN rank_delta > 0 OR group_delta > 0 THEN 'improved' WHEN rank_delta < 0 OR group_delta < 0 THEN 'worse' ELSE 'same' END AS direction FROM x""")
def rank_deltas(spark, d):
    g = gold(spark, d)
    return ev.deltas(ev.by_query(g, dense_lane(spark, d)), ev.by_query(g, hybrid(spark, d)))


@query("residual_failures", f"""
WITH {LANES}, {_per('den', 'p')}, {_DIM}, f AS (SELECT * FROM p JOIN dims USING (query_id) WHERE NOT full_5 OR first_rank IS NULL OR first_rank > 5)
SELECT CASE WHEN size IS NOT NULL THEN 'size' WHEN kind IS NOT NULL THEN 'kind' ELSE 'style' END AS dimension, coalesce(size, kind, style) AS value, count(*) AS failures FROM f GROUP BY GROUPING SETS ((size), (kind), (style))""")
def residual_failures(spark, d):
    per = ev.by_query(gold(spark, d), dense_lane(spark, d)).join(dimensions(spark, d), "query_id")
    failed = per.where(~F.col("full_5") | F.col("first_rank").isNull() | (F.col("first_rank") > 5))
    return failed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("size", "kind", "style")])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("failures"))


@query("recovery_ceiling", f"""
WITH {LANES}, {_per('lex', 'a')}, u AS (SELECT query_id, doc_id, min(rank) AS rank FROM (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM den) WHERE rank <= 10 GROUP BY 1, 2), {_per('u', 'b')}
SELECT count(*) AS questions, count(*) FILTER (WHERE NOT a.full_10) AS failures, count(*) FILTER (WHERE NOT a.full_10 AND b.full_10) AS recoverable FROM a JOIN b USING (query_id)""")
def recovery_ceiling(spark, d):
    """How many failures all lanes together could mend."""
    g, lex = gold(spark, d), lexical_lane(spark, d, 10)
    union = lex.select("query_id", "doc_id", "rank").unionByName(dense_lane(spark, d, 10).select("query_id", "doc_id", "rank")).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    both = ev.by_query(g, lex).select("query_id", F.col("full_10").alias("a")).join(ev.by_query(g, union).select("query_id", F.col("full_10").alias("b")), "query_id")
    return both.agg(F.count("*").alias("questions"), F.count_if(~F.col("a")).alias("failures"), F.count_if(~F.col("a") & F.col("b")).alias("recoverable"))


@query("system_costs", f"""
WITH {LANES}, a AS (SELECT g.query_id, count(DISTINCT group_id) FILTER (WHERE l.doc_id IS NOT NULL) AS h FROM gold g LEFT JOIN lex l ON l.query_id = g.query_id AND l.doc_id = g.doc_id AND l.rank <= 5 GROUP BY 1),
b AS (SELECT g.query_id, count(DISTINCT group_id) FILTER (WHERE l.doc_id IS NOT NULL) AS h FROM gold g LEFT JOIN hyb l ON l.query_id = g.query_id AND l.doc_id = g.doc_id AND l.rank <= 5 GROUP BY 1)
SELECT query_id, a.h AS single_hits, b.h AS coordinated_hits, CASE WHEN b.h > a.h THEN 'win' WHEN b.h < a.h THEN 'loss' ELSE 'tie' END AS outcome, 1::BIGINT AS single_searches, 2::BIGINT AS coordinated_searches FROM a JOIN b USING (query_id)""")
def system_costs(spark, d):
    g, lex = gold(spark, d), lexical_lane(spark, d)  # one search for both: its first ten are the single system's
    hits = lambda r, name: g.join(r.where("rank <= 5").select("query_id", "doc_id", F.lit(True).alias("hit")), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.countDistinct(F.when(F.col("hit"), F.col("group_id"))).alias(name))
    both = hits(lex, "single_hits").join(hits(hybrid(spark, d, lex), "coordinated_hits"), "query_id")
    result = F.when(F.col("coordinated_hits") > F.col("single_hits"), "win").when(F.col("coordinated_hits") < F.col("single_hits"), "loss").otherwise("tie")
    return both.select("*", result.alias("outcome"), F.lit(1).cast("long").alias("single_searches"), F.lit(2).cast("long").alias("coordinated_searches"))


@query("latency_percentiles", """
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    """Percentiles by linear interpolation."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile(v, 0.5), 6).alias("p50"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.round(F.median(v), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"))


PREDICTED = "r AS (SELECT l.quality::VARCHAR AS gold, CASE WHEN regexp_matches(text, '[*$%&#]{3}|!! |\\| ') THEN '0' WHEN length(text) < 60 THEN '2' ELSE '1' END AS predicted FROM documents JOIN labels l USING (doc_id))"


def predicted(spark, d):
    rule = F.when(F.col("text").rlike(r"[*$%&#]{3}|!! |\| "), "0").when(F.length("text") < 60, "2").otherwise("1")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").cast("string").alias("gold"), rule.alias("predicted"))


@query("confusion_matrix", f"WITH {PREDICTED} SELECT gold, predicted, count(*) AS n FROM r GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return ev.confusion(predicted(spark, d), "gold", "predicted")


_SCORES = f"""{PREDICTED}, l AS (SELECT gold AS label FROM r UNION SELECT predicted FROM r),
s AS (SELECT label, (SELECT count(*) FROM r WHERE gold = label) AS support, (SELECT count(*) FROM r WHERE predicted = label) AS predicted, (SELECT count(*) FROM r WHERE predicted = label AND gold = label) AS hits FROM l),
t AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS c FROM s), u AS (SELECT *, coalesce(2 * p * c / nullif(p + c, 0), 0) AS f FROM t)"""


@query("label_scores", f"WITH {_SCORES} SELECT label, support, round(p, 6) AS precision, round(c, 6) AS recall, round(f, 6) AS f1 FROM u")
def label_scores(spark, d):
    s = ev.label_scores(predicted(spark, d), "gold", "predicted")
    return s.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", f"WITH {_SCORES} SELECT round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f) FILTER (WHERE support > 0), 6) AS macro_f1 FROM u")
def macro_f1(spark, d):
    return ev.summary_scores(ev.label_scores(predicted(spark, d), "gold", "predicted"))


@query("threshold_calibration", r"""
WITH x AS (SELECT round(len(regexp_extract_all(text, '[*$%&#!|]'))::DOUBLE / length(text), 3) AS score, 1 - quality AS label FROM documents JOIN labels USING (doc_id)),
c AS (SELECT DISTINCT score AS threshold FROM x),
b AS (SELECT threshold, round((coalesce((SELECT count(*) FROM x WHERE label = 1 AND score >= threshold)::DOUBLE / nullif((SELECT count(*) FROM x WHERE label = 1), 0), 0)
  + 1 - coalesce((SELECT count(*) FROM x WHERE label = 0 AND score >= threshold)::DOUBLE / nullif((SELECT count(*) FROM x WHERE label = 0), 0), 0)) / 2, 6) AS balanced FROM c)
SELECT threshold, balanced FROM b ORDER BY balanced DESC, threshold DESC LIMIT 1""")
def threshold_calibration(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.length("text")
    score = F.when(n == 0, float("nan")).otherwise(F.regexp_count("text", F.lit("[*$%&#!|]")) / n)  # 0 / 0 is an error in ANSI mode
    rows = rows.select(F.round(score, 3).alias("score"), (1 - F.col("quality")).alias("label"))
    return fusion.calibrate(rows)


PAIRS = f"""pairs AS (SELECT l.query_id * 1000000 + l.doc_id AS id, {sql.tok('i.text')} AS a, {sql.tok('d.text')} AS b, i.text AS q, d.text AS t FROM lex l JOIN items i USING (query_id) JOIN documents d USING (doc_id) WHERE l.rank <= 3)"""


def pairs(spark, d):
    top = lexical_lane(spark, d, 3).select("query_id", "doc_id").join(items(spark, d).withColumnRenamed("text", "q"), "query_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("t")), "doc_id")
    return top.select((F.col("query_id") * 1000000 + F.col("doc_id")).alias("id"), "q", "t")


@query("lexical_coverage", f"""
WITH {sql.ITEMS}, {sql.bm25('items', 'documents', 3, 'lex')}, {PAIRS},
s AS (SELECT id, round(len(list_intersect(q, t))::DOUBLE / len(q), 6) AS score FROM (SELECT id, list_filter(list_distinct(a), lambda x: length(x) > 1 AND x NOT IN ('the', 'of', 'and')) AS q, list_filter(list_distinct(b), lambda x: length(x) > 1 AND x NOT IN ('the', 'of', 'and')) AS t FROM pairs))
SELECT id, score, CASE WHEN score >= 0.55 THEN 'sufficient' WHEN score >= 0.25 THEN 'partial' ELSE 'missing' END AS verdict FROM s""")
def lexical_coverage(spark, d):
    stop = ("the", "of", "and")
    s = pairs(spark, d).select("id", F.round(coverage(content_tokens(F.col("q"), stop), content_tokens(F.col("t"), stop)), 6).alias("score"), (F.trim("t") == "").alias("empty"))
    return s.select("id", "score", ev.verdict(F.col("score"), 0.55, 0.25, F.col("empty")).alias("verdict"))


@query("tfidf_cosine", f"""
WITH {sql.ITEMS}, {sql.bm25('items', 'documents', 3, 'lex')}, {PAIRS},
n AS (SELECT count(*) AS n FROM items), f AS (SELECT term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM (SELECT DISTINCT query_id, unnest({sql.tok('text')}) AS term FROM items), n GROUP BY term, n),
x AS (SELECT id, term, count(*)::DOUBLE / any_value(len) AS w FROM (SELECT id, len(a) AS len, unnest(a) AS term FROM pairs) GROUP BY 1, 2), y AS (SELECT id, term, count(*)::DOUBLE / any_value(len) AS w FROM (SELECT id, len(b) AS len, unnest(b) AS term FROM pairs) GROUP BY 1, 2),
z AS (SELECT id, coalesce(x.w, 0) * coalesce(idf, 1) AS u, coalesce(y.w, 0) * coalesce(idf, 1) AS v FROM x FULL JOIN y USING (id, term) LEFT JOIN f USING (term))
SELECT id, round(coalesce(sum(u * v) / nullif(sqrt(sum(u * u)) * sqrt(sum(v * v)), 0), 0), 6) AS score FROM z GROUP BY id""")
def tfidf_cosine(spark, d):
    corpus = items(spark, d).select(tokens(F.col("text")).alias("t"))
    return ev.tfidf_cosine(pairs(spark, d).select("id", tokens(F.col("q")).alias("a"), tokens(F.col("t")).alias("b")), corpus)


@query("tool_routing_accuracy", """
WITH p AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 'cross_subject' ELSE 'subject' END AS predicted, CASE WHEN turn % 2 = 0 THEN ['subject', 'graph'] ELSE ['cross_subject'] END AS acceptable FROM conversations WHERE role = 'user')
SELECT count(*) AS cases, count(*) FILTER (WHERE list_contains(acceptable, predicted)) AS acceptable, round(avg(list_contains(acceptable, predicted)::INT::DOUBLE), 6) AS accuracy FROM p""")
def tool_routing_accuracy(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    got = F.when(F.col("conv_id") % 3 == 0, "cross_subject").otherwise("subject")
    ok = F.array_contains(F.when(F.col("turn") % 2 == 0, F.array(F.lit("subject"), F.lit("graph"))).otherwise(F.array(F.lit("cross_subject"))), got)
    return rows.agg(F.count("*").alias("cases"), F.count_if(ok).alias("acceptable"), F.round(F.avg(ok.cast("double")), 6).alias("accuracy"))


# -- graph: suppliers of a nation are nodes, neighbours by key and by nation are edges -----------------------------

NODES = r"nodes AS (SELECT s_suppkey AS node_id, list_distinct(string_split(lower(n_name || ' ' || r_name), ' ')) AS words, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
EDGES = "edges AS (SELECT s_suppkey * 2 AS edge_id, s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey // 2 IN (SELECT s_suppkey FROM supplier) AND s_suppkey // 2 <> s_suppkey)"
ASKED = "asked AS (SELECT n_nationkey AS query_id, list_distinct(string_split(lower(n_name), ' ')) AS words FROM nation)"


def provenance(spark, d):
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    named = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    nodes = named.select(F.col("s_suppkey").alias("node_id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "n_name", "r_name")), " ")).alias("words"), "s_nationkey")
    key = F.col("s_suppkey")
    known = supplier.select(key.alias("dst"))
    edges = supplier.select((key * 2).alias("edge_id"), key.alias("src"), (key + 1).alias("dst")).unionByName(supplier.select((key * 2 + 1).alias("edge_id"), key.alias("src"), F.floor(key / 2).alias("dst")).where("dst <> src"))
    return nodes, edges.join(known, "dst", "left_semi").select("edge_id", "src", "dst")


@query("graph_paths", f"""
WITH RECURSIVE {NODES}, {EDGES}, {ASKED},
p AS (SELECT query_id, a.words AS q, [node_id] AS nodes, []::BIGINT[] AS edges, node_id AS at, n.words AS seen FROM asked a, nodes n WHERE len(list_intersect(a.words, n.words)) > 0
 UNION ALL SELECT query_id, q, list_append(p.nodes, e.dst), list_append(p.edges, e.edge_id), e.dst, list_distinct(seen || n.words) FROM p JOIN edges e ON e.src = p.at JOIN nodes n ON n.node_id = e.dst WHERE len(p.edges) < 2 AND NOT list_contains(p.nodes, e.dst)),
s AS (SELECT query_id, nodes, edges, round(len(list_intersect(q, seen))::DOUBLE / len(nodes), 6) AS score FROM p WHERE len(edges) > 0)
SELECT query_id::BIGINT AS query_id, array_to_string(nodes, '-') AS nodes, array_to_string(edges, '-') AS edges, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edges, nodes) AS rank FROM s) WHERE rank <= 5""")
def graph_paths(spark, d):
    nodes, edges = provenance(spark, d)
    asked = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.array_distinct(F.split(F.lower("n_name"), " ")).alias("words"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "-").alias(c)
    return graph.paths(nodes.select("node_id", "words"), edges, asked).select("query_id", text("nodes"), text("edges"), "score", "rank")


@query("graph_integrity", """
WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT DISTINCT 'unknown_node' AS issue, edge_id AS id FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier) OR dst NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'repeated_edge', edge_id FROM e GROUP BY edge_id HAVING count(*) > 1""")
def graph_integrity(spark, d):
    """Edges to parts that aren't suppliers are found."""
    edges = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.integrity(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), edges)


@query("components", """
WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS item, l_partkey || '|' || l_suppkey || '|' || l_linenumber AS parent FROM lineitem),
e AS (SELECT DISTINCT a.item AS x, b.item AS y FROM m a JOIN m b USING (parent)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS item, min(y) AS component FROM r GROUP BY x""")
def components(spark, d):
    """Orders with a line of equal part, supplier and number, over any chain."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber").alias("parent")).distinct()
    return graph.components(rows, "item", "parent")


@query("span_dedup", """
WITH s AS (SELECT l_orderkey AS path_id, list({'page': l_suppkey % 3, 'text': l_returnflag} ORDER BY l_linenumber, l_suppkey % 3, l_returnflag) AS spans FROM lineitem GROUP BY 1),
u AS (SELECT path_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS n FROM s), f AS (SELECT path_id, s, min(n) AS n FROM u GROUP BY 1, 2)
SELECT path_id, string_agg(s.page || s.text, ',' ORDER BY n) AS spans FROM f GROUP BY 1""")
def span_dedup(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path_id"))
    rows = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("page"), F.col("l_returnflag").alias("text")))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("spans"))
    return graph.distinct_spans(rows, "spans").select("path_id", F.array_join(F.transform("spans", lambda s: F.concat(s["page"].cast("string"), s["text"])), ",").alias("spans"))
