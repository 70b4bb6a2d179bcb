import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.operators import dense, fusion, lexical, routing
from corpusloom.plans import answers

RANKING = "query_id long, doc_id string, score double, rank long"


def ranked(spark, *ids, q=1, scores=None):
    return spark.createDataFrame([(q, d, float(scores[n] if scores else 1 / (n + 1)), n + 1) for n, d in enumerate(ids)], RANKING)


def order(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("query_id", "rank").collect()]


def docs(spark):
    return spark.createDataFrame([("c1", "Định nghĩa vật chất của V.I. Lênin", "A"), ("c2", "Phép biện chứng duy vật", "B"), ("c3", "", "A")], "doc_id string, text string, subject string")


def asked(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "query_id long, text string")


def test_bm25_ranks_and_filters(spark):
    got = lexical.bm25(docs(spark), asked(spark, "định nghĩa vật chất"), 5)
    assert order(got, "doc_id")[0] == ("c1",)
    other = lexical.bm25(docs(spark), asked(spark, "định nghĩa vật chất"), 5, keep=F.col("subject") == "B")
    assert order(other, "doc_id", "rank") == [("c2", 1)]
    both = {r["doc_id"]: r["score"] for r in got.collect()}
    assert other.first()["score"] == both["c2"]  # statistics stay those of all documents
    assert lexical.bm25(docs(spark), asked(spark, "nothing here"), 5).count() == 0
    assert lexical.bm25(docs(spark), asked(spark, "vật vật chất"), 5).collect() == lexical.bm25(docs(spark), asked(spark, "chất vật"), 5).collect()
    for bad in ({"k": 0}, {"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            lexical.bm25(docs(spark), asked(spark, "x"), **({"k": 1} | bad))


def test_postings(spark):
    got = {(r["doc_id"], r["term"]): (r["tf"], r["n_tokens"]) for r in lexical.postings(docs(spark)).collect()}
    assert got["c1", "vật"] == (1, 8)


def test_cosine(spark):
    vecs = spark.createDataFrame([(3, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (4, [0.0, 0.0], "a"), (5, None, "a")], "vec_id long, embedding array<float>, part string")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert order(dense.cosine_top_k(vecs, q, 10), "vec_id", "score") == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert order(dense.cosine_top_k(vecs, q, 2, partition="part"), "vec_id", "part") == [(1, "b"), (3, "a")]
    assert dense.cosine_top_k(vecs, q.limit(0), 2).count() == 0
    assert dense.normalized(vecs).count() == 3


def test_fusion(spark):
    a, b = ranked(spark, "lexical", "consensus"), ranked(spark, "dense", "consensus")
    got = fusion.reciprocal_rank_fusion([a, b], 3)
    assert order(got, "doc_id", "rank") == [("consensus", 1), ("dense", 2), ("lexical", 3)]
    c = ranked(spark, "a", "shared"), ranked(spark, "shared", "b")
    assert order(fusion.reciprocal_rank_fusion(list(c), 3, positional=True), "doc_id") == [("shared",), ("a",), ("b",)]
    assert order(fusion.round_robin([ranked(spark, "a", "b", "c"), ranked(spark, "b", "d")], 3), "doc_id") == [("a",), ("b",), ("d",)]


def test_merges(spark):
    a, b = ranked(spark, "x", "y", scores=[0.5, 0.4]), ranked(spark, "y", "z", scores=[0.4, 0.1])
    assert {(r["doc_id"], r["list_no"]) for r in fusion.merge_best(a, b).collect()} == {("x", 0), ("y", 0), ("z", 1)}
    assert {(r["doc_id"], r["list_no"]) for r in fusion.merge_last(a, b).collect()} == {("x", 0), ("y", 1), ("z", 1)}
    assert [r["doc_id"] for r in fusion.new_evidence(b, a).collect()] == ["z"]


def test_parents(spark):
    kids = spark.createDataFrame([(1, "c1", 1.0, 1), (1, "c2", 0.5, 2), (1, "c3", 1 / 3, 3)], "query_id long, child_id string, score double, rank long")
    parents = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2")], "child_id string, parent_id string")
    assert order(fusion.expand_to_parents(kids, parents, 5), "parent_id", "score", "rank") == [("p1", 1.0, 1), ("p2", 1 / 3, 2)]
    assert fusion.missing_parents(kids, parents.where("child_id <> 'c2'")).count() == 1


def test_gate_and_calibration(spark):
    q = asked(spark, "x", "y")
    r = ranked(spark, "d", scores=[0.5])
    one = {x["query_id"]: x["decision"] for x in fusion.gate(r, q, 0.7, 0.3).collect()}
    two = {x["query_id"]: x["decision"] for x in fusion.gate(r, q, 0.7, 0.3, rewritten=True).collect()}
    assert (one[1], one[2], two[1]) == ("rewrite", "refuse_out_of_domain", "refuse_insufficient")
    rows = spark.createDataFrame([(0.1, False), (0.2, False), (0.8, True), (0.9, True)], "score double, label boolean")
    assert fusion.calibrate(rows).first()["threshold"] == 0.8
    tie = spark.createDataFrame([(0.1, True), (0.2, False), (0.3, True)], "score double, label boolean")
    assert fusion.calibrate(tie).first()["threshold"] == 0.3


def test_threshold_of_empty_texts(spark, tmp_path):
    """An empty text has the score 0 / 0, which is above all numbers; a null text none."""
    import duckdb

    from corpusloom.queries import evaluation

    for texts, labels in (
        ([(0, ""), (1, "!!"), (2, "abc"), (3, "")], [(0, 0), (1, 0), (2, 1), (3, 0)]),
        ([(0, None), (1, "!!"), (2, "a!c"), (3, None)], [(0, 0), (1, 1), (2, None), (3, 1)]),
        ([(0, None), (1, "abc")], [(0, 0), (1, 1)]),
        ([(0, None), (1, None)], [(0, 0), (1, 1)]),
    ):
        spark.createDataFrame(texts, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = [tuple(r) for r in evaluation.threshold_calibration(spark, str(tmp_path)).collect()]
        assert str(got) == str(con.sql(evaluation.ORACLES["threshold_calibration"]).fetchall())


def test_scored_rows_are_dealt_by_number(spark, monkeypatch):
    """Tasks grow in number, not in size; the ranking is the same, ids may repeat, and rankings are tables."""
    texts = [(i % 25, " ".join(f"w{i * j % 7}" for j in range(1 + i % 9)) if i % 6 else None) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asks = asked(spark, "w1 w2 w3", "w0 w5", "none")
    want = {tuple(r) for r in lexical.bm25(docs, asks, 4).select("query_id", "doc_id", "score", "rank").collect()}
    monkeypatch.setattr(lexical, "ROWS_A_PART", 3)
    monkeypatch.setattr(lexical, "FEW_TERMS", 0)
    got = lexical.bm25(docs, asks, 4).select("query_id", "doc_id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == want and len(want) == 8
    assert "bm25-ranking-" in got._jdf.queryExecution().toString()


def test_postings_without_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a B"), (2, None), (3, "c"), (4, "")], "doc_id long, text string").coalesce(1)
    many = docs.repartition(16)
    want = {(1, "b", 2, 3), (1, "a", 1, 3), (3, "c", 1, 1)}
    for df in (docs, many):
        assert {(r["doc_id"], r["term"], r["tf"], r["n_tokens"]) for r in lexical.postings(df).collect()} == want
    assert "Aggregate" not in lexical.postings(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    twice = docs.unionByName(spark.createDataFrame([(1, "a a c"), (3, "c d")], "doc_id long, text string"))
    assert {(r["doc_id"], r["term"], r["tf"], r["n_tokens"]) for r in lexical.postings(twice).collect()} == {(1, "b", 2, 3), (1, "a", 3, 3), (1, "c", 1, 3), (3, "c", 1, 1), (3, "c", 1, 2), (3, "d", 1, 2)}


def test_support_gate(spark):
    base = ranked(spark, *[f"old_{i}" for i in range(10)])
    rows = [(1, 0, f"old_{i}", 0.1, 100 + i) for i in range(5)] + [(1, 0, "new", 0.9, 1), (1, 0, "worse", 0.2, 2)]
    targeted = spark.createDataFrame(rows, "query_id long, target_no int, doc_id string, score double, place long")
    got = fusion.support_gated(base, targeted, 5)
    assert order(got, "doc_id", "inserted") == [(f"old_{i}", False) for i in range(4)] + [("new", True)]
    assert order(fusion.support_gated(base, targeted, 5, margin=0.9), "doc_id") == [(f"old_{i}",) for i in range(5)]
    assert order(fusion.support_gated(base, targeted.limit(0), 5), "doc_id") == [(f"old_{i}",) for i in range(5)]


def test_routing(spark):
    q = asked(spark, "a) one b) two", "Compare x", "what is x", "the weather", "le chat et le chien", "plain")
    routes = {r["query_id"]: (r["route"], r["out_of_scope"]) for r in routing.route_question(q).collect()}
    assert [routes[i][0] for i in range(1, 7)] == ["mcq", "comparison", "definition", "general", "general", "general"] and routes[4][1]
    subject = {r["query_id"]: r["subject"] for r in routing.route_subject(q, routing.phrases(spark, routing.LANGUAGE_PHRASES)).collect()}
    assert subject[5] == "fr" and subject[6] is None
    assert routing.resolve_scope("global", None, ("a", "b")) == {"a", "b"} and routing.resolve_scope("within_subject", "a", ("a",)) == {"a"}
    for bad in (("global", "a"), ("within_subject", None), ("other", None)):
        with pytest.raises(ValueError):
            routing.resolve_scope(*bad, ("a",))
    assert routing.in_scope(q, "text", None).count() == 6 and routing.in_scope(q, "text", set()).count() == 0


def test_comparisons(spark):
    q = asked(spark, "So sánh quan điểm duy vật trước Mác và quan điểm triết học Mác-Lênin.", "Vật chất là gì?")
    got = routing.comparison_variants(q, r"^(?i:so sánh) (.{8,}?) (?:và|với) (.{8,})$").orderBy("query_id", "variant_no").collect()
    assert [r["variant"] for r in got] == ["quan điểm duy vật trước Mác", "quan điểm triết học Mác-Lênin", "Vật chất là gì?"]


def test_model_boundaries(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i long, t string")
    vec = df.select(models.embed(lambda: models.HashingEmbedder(8), 8)(F.col("t")).alias("v")).collect()
    assert all(len(r["v"]) == 8 and np.linalg.norm(r["v"]) > 0 for r in vec)
    with pytest.raises(Exception, match="finite vector"):
        df.select(models.embed(lambda: lambda ts: np.zeros((len(ts), 8)), 8)(F.col("t"))).collect()
    score = models.score_pairs(models.OverlapScorer)
    assert [r[0] for r in df.select(score(F.lit("a c"), F.col("t"))).collect()] == [0.5, 0.0]
    assert [models.batch_size(m) for m in (2_000, 6_144, 24_576)] == [4, 8, 64]


def small(spark):
    d = spark.createDataFrame([(i, f"chunk {i} speaks of topic{i % 4} and thing{i}") for i in range(1, 13)], "doc_id long, text string")
    v = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(1, 13)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, "topic1 thing5", [1.0, 1.0]), (2, "nothing known", [0.0, 1.0]), (3, "the weather", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    return d, v, q


def test_whole_plan(spark):
    d, v, q = small(spark)
    got = {r["query_id"]: r for r in answers.ask(d, v, q).collect()}
    assert got[1]["status"] == "generate" and got[1]["evidence_ids"][0] == 5 and "thing5" in got[1]["answer"]
    assert got[2]["status"] == got[3]["status"] == "refuse_out_of_domain" and got[2]["answer"] is None
    with pytest.raises(ValueError):
        answers.Baseline(fused=0)
    plan = answers.Baseline(pattern=r"^(.{3,}?) vs (.{3,})$")
    pair = q.where("query_id = 1").withColumn("text", F.lit("thing5 vs thing7"))
    assert {r["doc_id"] for r in answers.retrieve(d, v, pair, plan).where("rank <= 2").collect()} == {5, 7}


def test_variants_have_vectors_of_their_own(spark):
    d, v, q = small(spark)
    plan = answers.Baseline(pattern=r"^(.{3,}?) vs (.{3,})$", dense=3, shown=12)
    pair = q.where("query_id = 1").withColumn("text", F.lit("thing5 vs thing7"))
    of = lambda t: F.array(F.when(t.contains("thing7"), 3.0).otherwise(1.0).cast("float"), F.lit(1.0).cast("float"))
    found = lambda **how: {r["doc_id"] for r in answers.retrieve(d, v, pair, plan, **how).collect()}
    assert found() == {1, 5, 7, 9} and found(embed=of) == {1, 3, 5, 7, 9, 11}


def test_recovery_of_many_targets(spark):
    d, v, q = small(spark)
    base = spark.createDataFrame([(k, 1, 1, 0.1) for k in (1, 2)], "query_id long, doc_id long, rank int, score double")
    plan = spark.createDataFrame([(1, n, f"absent{n}") for n in range(20)] + [(1, 20, "thing7")], "query_id long, target_no int, text string")
    questions = spark.createDataFrame([(1, "thing7"), (2, "thing7")], "query_id long, text string")
    got = answers.recover(base, plan, lambda x: lexical.bm25(d, x, 5), questions, d, 3)
    assert {(r["query_id"], r["doc_id"]) for r in got.where("inserted").collect()} == {(1, 7)}


def test_recovery(spark):
    d, v, q = small(spark)
    base = lexical.bm25(d, q.select("query_id", "text").where("query_id = 1"), 10)
    search = lambda x: lexical.bm25(d, x, 5)
    plan = spark.createDataFrame([(1, 0, "thing7")], "query_id long, target_no int, text string")
    questions = spark.createDataFrame([(1, "thing7")], "query_id long, text string")
    got = order(answers.recover(base, plan, search, questions, d, 3), "doc_id", "inserted")
    assert (7, True) in got and len(got) <= 3
    assert not any(x for _, x in order(answers.recover(base, plan.limit(0), search, questions, d, 3), "doc_id", "inserted"))
    judge = lambda qs, ev: qs.select("query_id", F.lit("partial").alias("verdict"), F.array(F.lit("thing7"), F.lit("thing8"), F.lit("thing9")).alias("queries"))
    more = answers.bounded_recovery(questions, base.select("query_id", "doc_id", "score"), judge, search, rounds=1)
    assert {7, 8} <= {r["doc_id"] for r in more.collect()} and 9 not in {r["doc_id"] for r in more.collect()} - {r["doc_id"] for r in base.collect()}
    assert answers.traced(base, [("planner", "plan"), ("searcher", "search")]).count() == 2
