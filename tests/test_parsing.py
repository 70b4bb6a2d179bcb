import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fusion, parsing, routing, scan
from corpusloom.operators import vietnamese as vi

BLOCKS = "doc_id long, page long, line_no long, text string, role string, bold boolean, scanned boolean, y double"


def tree(spark, *lines, pages=None):
    rows = [(1, (pages or {}).get(n, 1), n, t, "body", True, False, 20.0 * n) for n, t in enumerate(lines)]
    return {r["line_no"]: r for r in parsing.parse_structure(spark.createDataFrame(rows, BLOCKS)).collect()}


def test_headings_count_from_the_first_chapter(spark):
    got = tree(spark, "1. Early", "text", "Chương 1", "MỞ ĐẦU", "1. Khái niệm", "text", "a) Một ý", "more")
    assert got[0]["level"] is None and got[1]["chapter"] is None
    assert 3 not in got and got[2]["text"] == "Chương 1 MỞ ĐẦU" and got[2]["absorbed"]
    assert (got[5]["chapter"], got[5]["section"], got[5]["subsection"]) == ("Chương 1 MỞ ĐẦU", "1. Khái niệm", None)
    assert got[7]["subsection"] == "a) Một ý" and got[6]["parent_line"] == 4


def test_zones(spark):
    got = tree(spark, "Chương 1", "text", "Câu hỏi ôn tập", "1. Một", "asked", "Kết luận", "told", "Tài liệu tham khảo", "1. Sách", "Kết luận", "Chương 2", "again", pages={10: 2, 11: 2})
    assert [n for n in range(12) if got[n]["excluded"]] == [2, 3, 4, 7, 8, 9]
    assert got[3]["level"] is None and got[6]["chapter"] == "Chương 1" and got[11]["chapter"] == "Chương 2"


def test_chapters_listed_at_the_end_are_contents(spark):
    got = tree(spark, "Chương 1", "text", "Chương 1", "Chương 2", "last", pages={0: 1, 1: 2, 2: 9, 3: 9, 4: 9})
    assert got[2]["excluded"] and got[2]["level"] is None and not got[1]["excluded"] and got[0]["level"] == 1


def test_scanned_blocks_anchors_batches(spark):
    b = spark.createDataFrame([(1, "b0", "body", True, ["x", "y"]), (2, "b0", "body", False, ["x", "y"])], "page_id long, block_id string, role string, scanned boolean, lines array<string>")
    assert {(r["page_id"], r["block_id"], r["text"]) for r in parsing.split_scanned_blocks(b).collect()} == {(1, "b0_l0", "x"), (1, "b0_l1", "y"), (2, "b0", "x\ny")}
    blocks = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "page long, block_id string, pos int")
    el = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (1, 2, "b"), (1, 3, "c"), (1, 4, "zz")], "page long, element_no int, block_id string")
    assert {tuple(r)[1:] for r in parsing.anchor_issues(el, blocks).collect()} == {(2, "out_of_order"), (3, "used_again"), (4, "unknown_block")}
    page = lambda *ps: spark.createDataFrame([(p,) for p in ps], "page long")
    got = {tuple(r) for r in parsing.batch_issues(page(1, 2), page(1, 1, 3), page(1, 1, 9)).collect()}
    assert got == {("missing_page", 2), ("unknown_page", 3), ("repeated_page", 1), ("repeated_correction", 1), ("correction_without_page", 9)}


def test_memory(spark):
    rows = [("m1", "a", "x", False, "2024-01-01"), ("m2", "a", "y", False, "2024-01-01"), ("m3", "b", "z", True, None)]
    df = spark.createDataFrame(rows, "memory_id string, account_id string, content string, evidence_eligible boolean, created_at string")
    assert all(r["passed"] for r in parsing.memory_checks(df, "a").collect())
    assert {r["check"] for r in parsing.memory_checks(df, "b").collect() if not r["passed"]} == {"never_evidence", "dated"}


def test_substantive(spark):
    df = spark.createDataFrame([("C", "1. Khái niệm", None), (None, "x", None), ("C", "Mục tiêu", None), ("C", None, "Câu hỏi")], "c string, s string, u string")
    assert [r[0] for r in df.select(parsing.substantive(F.col("c"), F.col("s"), F.col("u"))).collect()] == [True, False, False, False]


ROUTES = [("Vật chất là gì?", "definition", "MLN111"), ("So sánh vật chất và ý thức", "comparison", "MLN111"), ("Đáp án nào đúng?", "mcq", None), ("Phân tích đường lối đổi mới của Đảng Cộng sản Việt Nam", "essay", "VNR202"), ("Trích nguyên văn", "exact_quote", None), ("Triết học và hàng hóa", "general", None)]


@pytest.mark.parametrize("text,route,subject", ROUTES)
def test_vietnamese_rules(spark, text, route, subject):
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    assert routing.route_question(q, vi.QUESTION_RULES, vi.OUT_OF_SCOPE).first()["route"] == route
    assert routing.route_subject(q, routing.phrases(spark, vi.SUBJECT_PHRASES)).first()["subject"] == subject


TOOLS = [("Nội dung này ở trang nào?", "A", "source_page"), ("Dẫn nguồn giúp tôi", "A", "citation"), ("Mối quan hệ giữa vật chất và ý thức", "A", "graph"), ("So sánh giữa các môn", "A", "cross_subject"), ("Vật chất là gì", None, "cross_subject"), ("Vật chất là gì", "A", "subject")]


@pytest.mark.parametrize("text,subject,tool", TOOLS)
def test_vietnamese_tools(spark, text, subject, tool):
    df = spark.createDataFrame([(text, subject)], "t string, s string")
    assert df.select(routing.route_tool(F.col("t"), F.col("s"), vi.TOOL_RULES, vi.ACROSS)).first()[0] == tool


def test_follow_ups(spark):
    df = spark.createDataFrame([("Tại sao?",), ("Điều đó nghĩa là gì",), ("Vật chất là gì",)], "t string")
    assert [r[0] for r in df.select(routing.needs_context(F.col("t"), vi.REFERENCES, vi.SHORT_QUESTION)).collect()] == [True, True, False]


@pytest.mark.parametrize("down", [True, False])
def test_running_sums(spark, down):
    df = spark.createDataFrame([(i / 7, i % 5) for i in range(100)], "x double, v long")
    got = {round(r["x"] * 7): r["s"] for r in scan.running_sums(df, "x", {"s": "v"}, down, rows_a_part=13).collect()}
    assert all(got[i] == sum(j % 5 for j in (range(i, 100) if down else range(i + 1))) for i in range(100))
    assert fusion.calibrate(spark.createDataFrame([(0.1, 0)], "score double, label int").limit(0)).count() == 0
