import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from corpusloom.operators import structure as st


def test_spans_overlap():
    assert st.spans([10, 10, 10, 10], 25, 5) == [(0, 2), (1, 3), (2, 4)]
    assert st.spans([100], 25, 5) == [(0, 1)] and st.spans([], 25, 5) == []
    assert st.spans([30, 30], 25, 0) == [(0, 1), (1, 2)]


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.integers(1, 60), max_size=60), hs.integers(1, 100), hs.integers(0, 50))
def test_spans_cover_every_line(weights, target, overlap):
    made = st.spans(weights, target, overlap)
    assert {i for a, b in made for i in range(a, b)} == set(range(len(weights)))
    assert all(b - a == 1 or sum(weights[a:b]) <= target for a, b in made)
    assert all(y[0] > x[0] and y[0] <= x[1] for x, y in zip(made, made[1:]))


def test_chunks_keep_lines_and_ids(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i} has some words" for i in range(30))), (2, None)], "doc_id long, text string")
    one, two = (sorted(map(tuple, st.fixed_chunks(docs, 25, 5).select("chunk_id", "text").collect())) for _ in range(2))
    assert one == two
    text = docs.first()["text"].split("\n")
    assert {x for _, t in one for x in t.split("\n")} == set(text) | {""}


def test_parents_hold_children(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a b c"] * 10 + ["X | Y | Z"] * 5 + ["a b c"] * 10))], "doc_id long, text string")
    got = st.parent_child_chunks(docs, lambda x: F.contains(x, F.lit("|")).cast("string"), parent=20, target=9, overlap=3).collect()
    spans = {}
    for r in got:
        spans.setdefault(r["parent_no"], []).append((r["first_line"], r["last_line"]))
    parents = sorted((min(a for a, _ in v), max(b for _, b in v)) for v in spans.values())
    assert parents[0][0] == 0 and parents[-1][1] == 24 and all(x[1] + 1 == y[0] for x, y in zip(parents, parents[1:]))
    assert not any(a < 10 <= b or a < 15 <= b for a, b in parents)


def test_roles(spark):
    rows = [(1, p, y, t) for p in range(5) for y, t in ((0.05, f"Chapter {p}"), (0.5, "body text"), (0.95, str(p + 1)), (0.92, "xiv"), (0.97, f"foot {p}"))]
    df = spark.createDataFrame(rows, "doc long, page_id long, y double, text string")
    got = {(r["page_id"], r["y"]): r["role"] for r in st.marginal_roles(df, "doc").collect()}
    assert [got[2, y] for y in (0.05, 0.5, 0.95, 0.92, 0.97)] == ["header", "body", "page_number", "page_number", "footer"]


HEADINGS = [("Chương 2", False, False, 1), ("Chương 2 MỞ ĐẦU", False, False, 1), ("Chương 2 trình bày", False, False, None), ("II - Phần", False, False, 2), ("II. PHẦN", False, False, 2), ("II. Phần hai", False, False, None), ("1.2. Khái niệm", True, False, 3), ("1.2. Khái niệm.", False, True, None), ("a) Một ý", False, False, 4), ("* Nổi bật", True, False, 5), ("* Nổi bật", False, False, None), ("x" * 200, True, False, None), ("", True, True, None)]


@pytest.mark.parametrize("text,bold,scanned,level", HEADINGS)
def test_heading_levels(spark, text, bold, scanned, level):
    df = spark.createDataFrame([(text, bold, scanned)], "t string, b boolean, s boolean")
    assert df.select(st.heading_level(F.col("t"), F.col("b"), F.col("s"))).first()[0] == level


def test_section_paths(spark):
    rows = [(0, "early", None), (1, "C1", 1), (2, "S1", 2), (3, "body", None), (4, "U", 4), (5, "body", None), (6, "S2", 3), (7, "body", None), (8, "C2", 1), (9, "body", None)]
    df = spark.createDataFrame([(1, n, t, lv) for n, t, lv in rows], "doc_id long, line_no long, text string, level long")
    got = {r["line_no"]: (r["chapter"], r["section"], r["subsection"], r["parent_line"]) for r in st.section_paths(df).collect()}
    assert got[0] == (None, None, None, None) and got[3] == ("C1", "S1", None, None) and got[5] == ("C1", "S1", "U", None)
    assert got[4] == ("C1", "S1", "U", 2) and got[7] == ("C1", "S2", None, None) and got[9] == ("C2", None, None, None)
    assert got[2] == ("C1", "S1", None, 1) and got[6][3] == 2


def test_runs_and_latches(spark):
    df = spark.createDataFrame([(1, n, k) for n, k in enumerate("aabbaX..Y.")], "doc_id long, line_no long, text string")
    runs = [r["run"] for r in st.adjacent_runs(df, F.col("text")).orderBy("line_no").collect()]
    assert runs == [1, 1, 2, 2, 3, 4, 5, 5, 6, 7]
    on = [r["on"] for r in st.latched(df, F.col("text") == "X", F.col("text") == "Y", "on").orderBy("line_no").collect()]
    assert on == [False] * 5 + [True] * 3 + [False] * 2


def test_spaced_windows(spark):
    df = spark.createDataFrame([("g", p, float(p in (3, 4, 12)) * 10 - p / 100) for p in range(1, 21)], "g string, pos long, score double")
    got = sorted(tuple(r) for r in st.spaced_windows(df, "g", 2).collect())
    assert got == [("g", 3, 1, 5), ("g", 12, 10, 14)]


def test_html(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><!-- x --><script>a('<p>')</script><h1>Head</h1><p>one <b>two</b> &amp; three<br>four</body>"
    got = [r["text"] for r in st.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block_no").collect()]
    assert got == ["T", "Head", "one two & three", "four"]


def test_python_sees_no_texts(spark):
    """Parents and children need weights and keys alone; more documents than a slice give what each gives by itself."""
    from corpusloom.queries.corpus import kind

    rows = [(i, "\n".join(["a b c", "A | B | C", "UP"][(i + j) % 3] for j in range(1 + i % 5))) for i in range(2 * st.SLICE + 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole, bare = st.parent_child_chunks(df, kind), st.parent_child_chunks(df, kind, texts=False)
    spans = ["doc_id", "parent_no", "chunk_no", "first_line", "last_line"]
    assert sorted(whole.select(spans).collect()) == sorted(bare.select(spans).collect()) and bare.columns == spans
    assert all(r["text"] == "\n".join(rows[r["doc_id"]][1].split("\n")[r["first_line"] : r["last_line"] + 1]) for r in whole.collect())
    plan = bare._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "pythonUDF0" in plan and "InPandas" not in plan
