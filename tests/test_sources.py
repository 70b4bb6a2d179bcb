import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, sinks
from corpusloom.streaming import ingest


def lines(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"part-{len(list(path.iterdir()))}.json").write_text("\n".join(rows) + "\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    good = lines(tmp_path / "a", ['{"id": 1, "s": "x"}', "", '{"id": 2, "s": "x"}'])
    assert readers.read_jsonl(spark, good, "id long, s string", "id", "s").count() == 2
    again = lines(tmp_path / "b", ['{"id": 1, "s": "x"}', '{"id": 1, "s": "x"}'])
    with pytest.raises(ValueError, match="repeated"):
        readers.read_jsonl(spark, again, "id long, s string", "id").count()
    with pytest.raises(ValueError, match="malformed"):
        readers.read_jsonl(spark, lines(tmp_path / "c", ['{"id": 1, "s"']), "id long, s string", "id")
    with pytest.raises(ValueError, match="mixes"):
        readers.read_jsonl(spark, lines(tmp_path / "d", ['{"id": 1, "s": "x"}', '{"id": 2, "s": "y"}']), "id long, s string", "id", "s")


def test_scanned_words(spark, tmp_path):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"
    body = ["5\t1\t1\t1\t1\t2\t60\t20\t40\t20\t90\ttưởng", "5\t1\t1\t1\t1\t1\t20\t40\t40\t20\t91\tTư", '5\t1\t1\t1\t2\t1\t20\t170\t170\t20\t90.5\t"Việt', "5\t1\t1\t1\t2\t2\t60\t170\t40\t20\t-1\tlost", "4\t1\t1\t1\t2\t0\t0\t0\t500\t500\t99\tline"]
    (tmp_path / "x.tsv").write_text("\n".join([head, *body]) + "\n")
    words = readers.read_tsv_words(spark, str(tmp_path / "x.tsv"))
    got = readers.ocr_lines(words, scale=2, width=80).orderBy("line").collect()
    assert [(r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["confidence"]) for r in got] == [("Tư tưởng", 10, 10, 50, 30, 0.905), ('"Việt', 10, 85, 80, 95, 0.905)]
    block = readers.ocr_blocks(readers.ocr_lines(words, scale=2)).first()
    assert (block["text"], block["x0"], block["y1"]) == ('Tư tưởng\n"Việt', 10, 95)


def test_reviews_and_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿id,notes\n1,"two\nlines, ""quoted"""\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_review_csv(spark, str(tmp_path / "r.csv")).collect()] == [("1", 'two\nlines, "quoted"')]
    (tmp_path / "r.md").write_text("# q1\n- [x] accept\n- [ ] reject\nNotes: fine\n---\n# q2\n- [x] accept\n- [x] reject\nNotes:\n")
    md = {r["review_id"]: (r["decision"], r["notes"]) for r in readers.parse_review_markdown(spark.read.text(str(tmp_path / "r.md"), wholetext=True)).collect()}
    assert md == {"q1": ("accept", "fine"), "q2": (None, "")}
    (tmp_path / "rep.json").write_text(json.dumps({"variant": "v", "per_query": [{"q": 1}, {"q": 2}]}))
    assert {tuple(r) for r in readers.read_reports(spark, str(tmp_path / "rep.json")).collect()} == {("v", 1), ("v", 2)}


def test_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"one|two||")
    files = readers.file_digests(spark, str(tmp_path / "f"))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    manifest = spark.createDataFrame([("a.bin", named.first()["sha256"]), ("gone", "x")], "name string, sha256 string")
    assert {tuple(r) for r in readers.verify_release(named, manifest).collect()} == {("a.bin", "ok"), ("gone", "missing")}

    def parser(content):
        for n, t in enumerate(content.decode().split("|")):
            yield {"page": n, "text": t}

    raw = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    got = [(r["page"], r["method"]) for r in readers.parsed_pages(raw, parser, "path string, page long, text string, method string").orderBy("page").collect()]
    assert got == [(0, "native"), (1, "native"), (2, "none"), (3, "none")]


def test_blocks_and_pending(spark):
    block = "array<struct<type:int,lines:array<struct<text:string,size:double,flags:array<int>>>>>"
    rows = [(1, [(0, [("a", 9.0, [16]), (" ", 9.0, [1]), ("b", 11.0, [4, 16])]), (1, [("image", 1.0, [])]), (0, [("", 1.0, [])])])]
    got = readers.flat_blocks(spark.createDataFrame(rows, f"page_id long, blocks {block}")).collect()
    assert [(r["text"], r["font_size"], r["flags"]) for r in got] == [("a\nb", 11.0, [4, 16])]
    work, done = spark.createDataFrame([(1,), (2,)], "p long"), spark.createDataFrame([(1,)], "p long")
    assert [r["p"] for r in readers.pending(work, done, "p").collect()] == [2]
    with pytest.raises(ValueError):
        readers.pending(work, done.union(done), "p")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    assert sinks.content_hash(df).first() == sinks.content_hash(df.orderBy(F.desc("id")).repartition(3)).first() != sinks.content_hash(df.where("id = 1")).first()
    path = f"file://{tmp_path}/t"
    sinks.replace_table(df, path)
    sinks.replace_table(df.where("id = 1"), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        sinks.replace_table(df.where("id = 9"), path)
    assert spark.read.parquet(path).count() == 1
    new = spark.createDataFrame([(2, "new"), (3, "c")], "id long, t string")
    assert {tuple(r) for r in sinks.merged(df, new, ["id"], delete=new.where("id = 3")).collect()} == {(1, "a"), (2, "new")}
    assert sinks.write_jsonl(df, str(tmp_path / "j"), str(tmp_path / "m")).first()["rows"] == 2


def test_merges_don_t_depend_on_order(spark):
    old = spark.createDataFrame([(1, "x", 0)], "id long, t string, v long")
    for rows in ([(1, "a", 2), (1, "b", 1)], [(1, "b", 1), (1, "a", 2)]):
        new = spark.createDataFrame(rows, "id long, t string, v long")
        assert [r["t"] for r in sinks.merged(old, new, ["id"], order=("v",)).collect()] == ["a"]
        assert [r["t"] for r in sinks.merged(old, new, ["id"]).collect()] == ["b"]


def test_upsert_after_an_end_between_renames(spark, tmp_path):
    import os

    source = lines(tmp_path / "in", [f'{{"id": {i}, "v": 1, "text": "a"}}' for i in range(5)])
    table, mark = f"file://{tmp_path}/table", str(tmp_path / "mark")
    run = lambda: ingest.upsert(ingest.page_stream(spark, source, "id long, v long, text string"), table, mark, ["id"], "v").awaitTermination(120)
    assert run()
    os.rename(tmp_path / "table", tmp_path / "table.old-1")  # the old table is away, the new one not yet there
    spark.range(1).write.parquet(f"{table}.new-2")
    lines(tmp_path / "in", ['{"id": 9, "v": 1, "text": "c"}'])
    assert run()
    assert spark.read.parquet(table).count() == 6
    assert not [x for x in os.listdir(tmp_path) if x.startswith("table.")]


def test_stream_upserts(spark, tmp_path):
    source = lines(tmp_path / "in", ['{"id": 1, "v": 1, "text": "a"}', '{"id": 1, "v": 2, "text": "b"}'])
    table, mark = f"file://{tmp_path}/table", str(tmp_path / "mark")
    run = lambda: ingest.upsert(ingest.page_stream(spark, source, "id long, v long, text string"), table, mark, ["id"], "v").awaitTermination(120)
    assert run()
    lines(tmp_path / "in", ['{"id": 2, "v": 1, "text": "c"}', '{"id": 1, "v": 0, "text": "late"}'])
    assert run() and run()
    assert {(r["id"], r["text"], r["needs_ocr"]) for r in spark.read.parquet(table).collect()} == {(1, "b", True), (2, "c", True)}
    log = ingest.append_log(ingest.page_stream(spark, source, "id long, v long, text string"), str(tmp_path / "log"), str(tmp_path / "mark2"))
    assert log.awaitTermination(120) and spark.read.json(str(tmp_path / "log")).count() == 4
