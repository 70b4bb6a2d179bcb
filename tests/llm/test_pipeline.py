import corpus_pipeline as cp
import pytest
from llm_cases import frame, rows, simple
from test_line_dedup import brute
from test_near_copies import brute as one_of_each

from corpusloom.llm import packing, quality, registry
from corpusloom.llm.common import table


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, sf, "documents").select(*cp.COLUMNS), []
    for n, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, sf).write.parquet(str(where / str(n)))
        docs = spark.read.parquet(str(where / str(n)))
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_each_stage_on_its_own_input(spark, sf, staged):
    docs = table(spark, sf, "documents")
    kept = {r["doc_id"] for r in quality.scored(docs, table(spark, sf, "labels")).where("score >= 0.5").collect()}
    assert {d for d, _ in pairs(staged[0])} == kept
    assert sorted(pairs(staged[1])) == sorted((d, t) for d, t, _, _ in brute(pairs(staged[0])))
    before = pairs(staged[1])
    stay = one_of_each(before)
    assert sorted(pairs(staged[2])) == sorted(x for x in before if x[0] in stay)
    assert set(pairs(staged[3])) < set(pairs(staged[2]))
    assert {r["doc_id"] for r in staged[4].collect()} == {d for d, _ in pairs(staged[3])}


def test_columns(staged):
    for df in staged[:-1]:
        assert tuple(df.columns) == cp.COLUMNS
        assert df.where("n_chars <> length(text)").count() == 0


def test_run_is_the_stages(spark, sf, staged):
    one = {tuple(r) for r in cp.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert one == {tuple(r) for r in staged[4].select("doc_id", "piece", "length", "ids_crc32").collect()}


@pytest.mark.parametrize("n", range(5))
def test_edges(spark, sf, n):
    docs = frame(spark)
    got = cp.STAGES[n][1](spark, docs, sf)
    assert got.count() > 0
    assert cp.STAGES[n][1](spark, docs.limit(0), sf).count() == 0


def test_one_of_each_group_stays(spark, sf):
    got = pairs(cp.drop_near_copies(spark, frame(spark), sf))
    data = [(r[0], r[1]) for r in rows()]
    numbered = [(n, t) for n, (_, t) in enumerate(sorted(data, key=lambda x: (x[0] is None, x[0] or 0)))]
    assert len(got) == len(one_of_each(numbered)) < len(data)  # one row a group, whatever the ids
    assert pairs(cp.drop_near_copies(spark, simple(spark, data[:1]).selectExpr("doc_id", "text", "'x' lang", "'y' source", "1L n_chars"), sf)) == data[:1]


def test_one_id_of_two_groups(spark, sf):
    data = [(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "a b c d e f g"), (None, "o p q r s t u"), (None, "o p q r s t u"), (2, "H i j k l m n")]
    got = pairs(cp.drop_near_copies(spark, simple(spark, data).selectExpr("doc_id", "text", "'x' lang", "'y' source", "1L n_chars"), sf))
    assert sorted(got, key=str) == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t u")], key=str)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert packing.SEQ_LEN == 4096
