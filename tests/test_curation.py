import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from corpusloom.operators import curate, evaluate, graph, stores


def test_near_duplicates_as_brute_force(spark):
    @settings(max_examples=12, deadline=None)
    @given(hs.lists(hs.lists(hs.sampled_from("abcdefgh"), max_size=9), max_size=14))
    def check(sets):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, tokens array<string>")
        got = {(r["a"], r["b"]) for r in curate.near_duplicates(df, threshold=0.6).collect()}
        want = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        pairs = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if round(want(set(sets[i]), set(sets[j])), 6) >= 0.6}
        assert got <= pairs
        rep = {}
        for i, s in enumerate(sets):
            rep.setdefault(frozenset(s), i)
        first = {i: rep[frozenset(s)] for i, s in enumerate(sets)}
        assert {tuple(sorted((first[a], first[b]))) for a, b in pairs if first[a] != first[b]} == {p for p in got if first[p[0]] != first[p[1]]}
        assert {(first[i], i) for i in first if first[i] != i} == {p for p in got if first[p[0]] == first[p[1]]}

    check()


def test_near_duplicates_in_rounds(spark, monkeypatch):
    """Longer sets as brute force pairs them; pairs that outnumber the sets are compared some at a time."""
    rng = random.Random(5)
    base = [rng.sample(range(400), n) for n in (7, 20, 20, 33, 60, 61)]
    sets = [[f"w{x}" for x in s[: len(s) - rng.randrange(4)]] + [f"z{rng.randrange(30)}"] for s in base for _ in range(9)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    monkeypatch.setattr(curate, "PAIRS_A_SET", 1)
    got = curate.near_duplicates(df)
    rep = {}
    for i, s in enumerate(sets):
        rep.setdefault(frozenset(s), i)
    want = {(a, b, round(len(x & y) / len(x | y), 6)) for x, a in rep.items() for y, b in rep.items() if a < b}
    want = {p for p in want if p[2] >= 0.85} | {(rep[frozenset(s)], i, 1.0) for i, s in enumerate(sets) if rep[frozenset(s)] != i}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("near-found-") > 1 and "Join" not in plan


def test_quota(spark):
    have = spark.createDataFrame([("direct", 2)], "category string, n long")
    got = [r["category"] for r in curate.quota_plan(spark, [("direct", 3), ("explanation", 2)], have).orderBy("place").collect()]
    assert got == ["direct", "explanation", "explanation"]


def test_split_keeps_parents_together(spark):
    rows = [(i, 100 if i < 3 else 200 + i, "e" if i % 2 else "f") for i in range(10)]
    df = spark.createDataFrame(rows, "item long, parent long, kind string")
    one = {r["item"]: r["split"] for r in curate.component_split(df, "item", "parent", 4, ["kind"], "fixed").collect()}
    two = {r["item"]: r["split"] for r in curate.component_split(df.orderBy(F.desc("item")), "item", "parent", 4, ["kind"], "fixed").collect()}
    assert one == two and sorted(one.values()).count("hidden") == 4 and len({one[0], one[1], one[2]}) == 1
    joined = df.join(spark.createDataFrame(list(one.items()), "item long, split string"), "item")
    assert curate.leakage(joined, "parent").count() == 0
    with pytest.raises(ValueError):
        curate.component_split(spark.createDataFrame([(1, 5, "e"), (2, 5, "e")], "item long, parent long, kind string"), "item", "parent", 1, ["kind"], "x")


def test_selection_balances(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", "x" if i % 2 else "y") for i in range(12)], "id long, ch string, kind string")
    got = [r["id"] for r in curate.balanced_selection(df, 4, "id", ("ch", "kind")).orderBy("place").collect()]
    assert len(got) == 4 and sum(i < 8 for i in got) == 2 and sum(i % 2 for i in got) == 2


def test_reviews_patches_batches(spark):
    draft = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, q string")
    review = spark.createDataFrame([(1, "a", "ok"), (2, "x", "ok"), (4, "d", "ok")], "id long, q string, decision string")
    got = {(r["issue"], r["id"]) for r in curate.review_issues(draft, review, "id", ["q"], ("ok",)).collect()}
    assert got == {("changed", 2), ("missing_review", 3), ("unknown_id", 4)}
    assert {tuple(r) for r in curate.patched(draft, spark.createDataFrame([(2, "z")], "id long, q string"), "id", ["q"]).collect()} == {(1, "a"), (2, "z"), (3, "c")}
    batches = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 9)], "batch long, id long")
    assert {r["id"] for r in curate.reject_batches(batches, draft, "batch", "id").collect()} == {1, 2}


def test_retrieval_metrics(spark):
    gold = spark.createDataFrame([(1, "g1", 3, 2, True), (1, "g2", 5, 2, True)], "query_id long, group_id string, doc_id long, grade int, required boolean")
    ranking = spark.createDataFrame([(1, i, i) for i in range(1, 7)], "query_id long, doc_id long, rank long")
    m = evaluate.metrics(evaluate.by_query(gold, ranking)).first()
    assert (m["recall_1"], m["recall_3"], m["group_recall_3"], m["group_recall_5"], m["full_5"]) == (0, 1, 0.5, 1, 1)
    assert m["mrr"] == 0.333333


OUTCOMES = [((False, True, 3, 3), "win"), ((True, False, 1, 1), "loss"), ((True, True, 3, 1), "win"), ((True, True, 1, 3), "loss"), ((True, True, 2, 2), "tie"), ((False, False, None, 4), "mixed"), ((False, False, 4, None), "loss"), ((False, False, 4, 2), "tie")]


@pytest.mark.parametrize("case,want", OUTCOMES)
def test_outcomes(spark, case, want):
    df = spark.createDataFrame([case], "a boolean, b boolean, x long, y long")
    assert df.select(evaluate.outcome(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).first()[0] == want


def test_containment(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "xabc"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "abc"), (2, "bc d"), (3, "abc"), (4, "")], "query_id long, text string")
    for batch in (20_000, 2):
        assert {tuple(r) for r in evaluate.containment(docs, items, batch).collect()} == {(1, 1), (3, 1), (2, 1), (1, 2), (3, 2)}


def test_graph(spark):
    nodes = spark.createDataFrame([("matter", ["matter"]), ("mind", ["consciousness"]), ("far", ["far"])], "node_id string, words array<string>")
    edges = spark.createDataFrame([("edge_1", "matter", "mind"), ("edge_2", "mind", "matter")], "edge_id string, src string, dst string")
    q = spark.createDataFrame([(1, ["matter", "consciousness"]), (2, ["far"])], "query_id long, words array<string>")
    got = graph.paths(nodes, edges, q).orderBy("rank").collect()
    assert [(r["query_id"], r["edges"], r["score"]) for r in got] == [(1, ["edge_1"], 1.0), (1, ["edge_2"], 1.0)]
    bad = edges.union(spark.createDataFrame([("edge_1", "matter", "gone")], "edge_id string, src string, dst string"))
    assert {tuple(r) for r in graph.integrity(nodes, bad).collect()} == {("repeated_edge", "edge_1"), ("unknown_node", "edge_1")}
    members = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "q"), (4, None)], "item long, parent string")
    assert {tuple(r) for r in graph.components(members, "item", "parent").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    chain = spark.createDataFrame([(i, i // 2 * 2) for i in range(1000)] + [(i, -((i + 1) // 2)) for i in range(1, 1001)], "item long, parent long")
    assert {r["component"] for r in graph.components(chain, "item", "parent").collect()} == {0}


def test_stores(spark):
    ev = spark.createDataFrame([(1, ["s1"])], "evidence_id long, spans array<string>")
    cited = spark.createDataFrame([(1, 1, "s1"), (2, 1, "s2"), (3, 9, "s1")], "citation_id long, evidence_id long, span string")
    assert {tuple(r) for r in stores.verify_citations(cited, ev).collect()} == {(1, "ok"), (2, "unknown_span"), (3, "unknown_evidence")}
    talk = spark.createDataFrame([(1, n, "user" if n % 2 else "assistant", "t" * (70 if n == 1 else 3)) for n in range(9)] + [(2, 0, "system", "x")], "c long, n long, role string, text string")
    assert [r["n"] for r in stores.recent(talk, "c", "n").where("c = 1").orderBy("place").collect()] == [3, 4, 5, 6, 7, 8]
    titles = {r["c"]: r["title"] for r in stores.titles(talk, "c", "n").collect()}
    assert titles[1] == "t" * 60 + "…" and titles[2] is None
    calls = spark.createDataFrame([(1, n, n == 1) for n in range(4)], "trace long, n long, failed boolean")
    assert [r["status"] for r in stores.budgeted(calls, "trace", "n", 3).orderBy("n").collect()] == ["ok", "tool_error", "ok", "budget_exceeded"]


def test_span_matches_and_anchors(spark):
    e = spark.createDataFrame([(1, "e", 0.0, 0.0, 10.0, 10.0)], "page long, evidence_id string, x0 double, y0 double, x1 double, y1 double")
    c = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 8.0), (1, "b", 0.0, 0.0, 10.0, 7.0), (1, "c", 0.0, 0.0, 3.0, 3.0), (2, "d", 0.0, 0.0, 10.0, 10.0)], "page long, chunk_id string, x0 double, y0 double, x1 double, y1 double")
    assert {(r["chunk_id"], r["primary"]) for r in stores.span_matches(e, c).collect()} == {("a", True), ("b", False)}
    blocks = spark.createDataFrame([(1, "p1_b1"), (1, "p1_b2")], "page long, block_id string")
    anchors = spark.createDataFrame([(1, "p1_b1"), (1, "_b2"), (1, "p1"), (2, "x")], "page long, anchor string")
    assert {r["anchor"]: r["block_id"] for r in stores.anchors_repaired(anchors, blocks).collect()} == {"p1_b1": "p1_b1", "_b2": "p1_b2", "p1": None, "x": None}


def test_anchors_are_looked_up(spark):
    """Blocks that begin and end alike count once, equal blocks twice; a page's blocks and anchors aren't paired."""
    blocks = spark.createDataFrame([(1, "aba"), (1, "cd"), (1, "cd"), (2, "xyz"), (2, "xy"), (3, "")], "page long, block_id string")
    asked = [(1, "a"), (1, "c"), (1, "cd"), (1, "b"), (1, ""), (1, None), (2, "x"), (2, "yz"), (2, "xy"), (2, "xyzz"), (3, ""), (4, "a")]
    got = stores.anchors_repaired(spark.createDataFrame(asked * 2, "page long, anchor string"), blocks)
    want = {(1, "a"): "aba", (1, "cd"): "cd", (2, "yz"): "xyz", (2, "xy"): "xy", (3, ""): ""}
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*a, want.get(a))) for a in asked)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search(r"Join \[[^,\]]*page#\d+L\]", plan)


def test_scores_and_checks(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "gold string, predicted string")
    got = {r["label"]: (r["support"], round(r["precision"], 3), round(r["recall"], 3)) for r in evaluate.label_scores(rows, "gold", "predicted").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (2, 0.5, 0.5), "c": (0, 0.0, 0.0)}
    one = evaluate.summary_scores(evaluate.label_scores(rows, "gold", "predicted")).first()
    assert one["accuracy"] == 0.5 and one["macro_f1"] == round((2 / 3 + 0.5) / 2, 6)
    assert {tuple(r) for r in stores.checks({"some": F.count("*") > 0, "none": F.count("*") == 0}, rows).collect()} == {("some", True), ("none", False)}
