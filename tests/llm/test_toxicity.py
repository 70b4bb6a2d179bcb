import numpy as np
from llm_cases import empty, frame, rows

from corpusloom.llm import toxicity as tx
from corpusloom.llm.common import table


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, toxic int, text string")


def test_counts_as_brute_force(spark):
    data = [(1, "bad Word word."), (2, None), (3, "word good"), (None, "bad")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    pos = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    want = np.zeros(4 * tx.BUCKETS + 64, np.int64)
    view = want[: 4 * tx.BUCKETS].reshape(2, 2, -1)
    for doc, text in data:
        own = sorted({int(b) for b in tx.buckets(text or "").ravel()})
        for kind in (0, 1) if doc == 1 else (0,):
            view[kind, tx.half(doc), own] += 1
            want[4 * tx.BUCKETS + 2 * kind + tx.half(doc)] += 1
    assert (tx.counts(df, pos) == want).all()


def test_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    pos = rng.normal(2, 1, (400, 3))
    mix = np.concatenate([rng.normal(2, 1, (300, 3)), rng.normal(-1, 1, (2700, 3))])
    net = tx.Risk.fit(pos, mix, 0.1)
    s = net.score(mix)
    assert (s[:300] > 0.5).mean() > 0.9 and (s[300:] > 0.5).mean() < 0.03


def test_planted_words_are_caught(spark):
    rng = np.random.default_rng(5)
    words = [f"plain{i}" for i in range(300)]
    bad = ["vile", "nasty", "horrid"]
    data, known = [], []
    for i in range(1200):
        text = rng.choice(words, 60).tolist()
        toxic = i % 10 == 0
        if toxic:
            text[3:3] = rng.choice(bad, 2).tolist()
        data.append((i, " ".join(text)))
        if i % 3 == 0:
            known.append((i, int(toxic), "x"))
    got = {r["doc_id"]: r["score"] for r in tx.scored(spark.createDataFrame(data, "doc_id long, text string"), labels(spark, known)).collect()}
    hit = [got[i] >= tx.THRESHOLD for i in range(0, 1200, 10)]
    assert np.mean(hit) > 0.95
    assert np.mean([got[i] >= tx.THRESHOLD for i in range(1200) if i % 10]) < 0.03


def test_edges(spark):
    known = labels(spark, [(0, 1, "x"), (3, 1, "x"), (6, 0, "x"), (6, 0, "x"), (None, 1, "x"), (9, None, "x")])
    got = tx.scored(frame(spark), known, carry=("lang",)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in tx.scored(frame(spark), labels(spark, [])).collect()} == {0.0}
    assert tx.scored(empty(spark), known).count() == 0


def test_held_out_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = tx.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    hit, real = got["predicted"] == 1, got["toxic"] == 1
    assert (hit & real).sum() / real.sum() >= 0.9 and (hit & real).sum() / hit.sum() >= 0.9
