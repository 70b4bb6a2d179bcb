import numpy as np
import pyarrow as pa
import pytest
from llm_cases import empty, frame, rows

from corpusloom.llm import quality as q
from corpusloom.llm.common import table


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int, text string")


def test_context_sums_as_brute_force(spark, monkeypatch):
    data = [(1, "one two THREE three three"), (2, None), (3, "two!! one 22"), (4, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = np.zeros((q.BUCKETS, q.DIM), np.int64)
    places, signs = q.index_vectors()
    for _, text in data:
        seq = q.tokens(text or "").tolist()
        for i, a in enumerate(seq):
            for j in range(max(0, i - q.WINDOW), min(len(seq), i + q.WINDOW + 1)):
                if i != j:
                    for p, s in zip(places[seq[j]], signs[seq[j]]):
                        want[a, p] += int(s)
    assert (q.context_sums(df) == want).all()


def test_tokens_tell_case_signs_and_repeats():
    a, b = q.tokens("Word word").reshape(-1, 2)
    assert a[0] == b[0] and a[1] != b[1] and b[1] == q._AGAIN
    upper, lower, loud, louder = q.word_tokens(pa.array(["WORD", "word", "word!!", "word!!!!!!!!!!"])).tolist()
    assert upper[0] == lower[0] == loud[0] and len({x[1] for x in (upper, lower, loud, louder)}) == 4
    long = ["a1" * 40 + "b", "a1" * 40 + "B"]  # a shape is read to its end
    assert q.word_tokens(pa.array(long))[0, 1] != q.word_tokens(pa.array(long))[1, 1]
    assert len(q.tokens("")) == 0


def test_pooled_as_brute_force():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(q.BUCKETS, q.DIM)).astype(np.float32)
    data = ["one two THREE three three", None, "two!! one 22", "", " x  y ", "word " * 5000 + "end"]
    got = q.pooled(pa.array(data), vectors)
    for text, row in zip(data, got):
        x = vectors[q.tokens(text or "")].astype(float)
        want = np.concatenate([x.mean(axis=0), x.std(axis=0), x.min(axis=0), x.max(axis=0), [np.log1p(len(x)) / 10]]) if len(x) else np.zeros(4 * q.DIM + 1)
        assert np.allclose(row, want, atol=2e-3)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] * 2)))
    y = (rng.random(4000) < p).astype(float)
    net = q.Network.fit(x[:3000], y[:3000])
    s = net.score(x[3000:])
    assert ((s > 0.5) == (p[3000:] > 0.5)).mean() > 0.85
    assert abs(s.mean() - y[3000:].mean()) < 0.05


def test_edges(spark):
    known = labels(spark, [(0, 1, 0, "x"), (3, 0, 0, "x"), (3, 0, 1, "x"), (6, 1, 0, "x"), (9, None, 0, "x"), (None, 1, 0, "x"), (12, 1, 0, "x"), (15, 0, 0, "x")])
    got = q.scored(frame(spark), known, carry=("lang",)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1000] == by[1001] == by[1002]
    assert q.scored(empty(spark), known).count() == 0
    none = q.scored(frame(spark), labels(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    got = q.op4_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
