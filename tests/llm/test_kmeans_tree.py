import numpy as np
import pytest

from corpusloom.llm import kmeans_tree as kt


def truth(ids, x, q, k=5):
    s = kt.cosines(x[q], x)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]]
    return [(int(ids[j]), float(s[j])) for j in order[:k]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query_id int")


def test_recall_ranks_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # one common vector
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = {}
    for r in kt.nearest(df, df.where("vec_id % 50 = 0"), leaf_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, hit, total = np.arange(3000), 0, 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        want = truth(ids, x.astype(float), q)
        assert [f[0] for f in found] == list(range(1, 6))
        hit += len({w[0] for w in want} & {f[1] for f in found})
        total += 5
        exact = kt.cosines(x[q].astype(float), x[[f[1] for f in found]].astype(float))
        assert np.allclose([f[2] for f in found], exact, atol=1e-15)
    assert hit / total >= 0.9
    assert [f[1] for f in got[150]] == [100, 101, 102, 103, 104]  # ties to the smaller id


def test_rows_that_take_no_part(spark):
    bad = [(10, None, 0, 0), (11, [0.0, 0.0], 0, 0), (12, [float("nan"), 1.0], 0, 0), (13, [float("inf"), 1.0], 0, 0), (14, [None, 1.0], 0, 0), (15, [1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (16, [], 0, 0)]
    good = [(0, [1.0, 0.0], 0, 0), (1, [1.0, 0.1], 0, 0), (2, [0.0, 1.0], 0, 0), (2, [0.0, 1.0], 0, 0), (50, [1.0, 0.0], 0, 0)]
    df = frame(spark, bad + good)
    got = sorted(tuple(r)[:3] for r in kt.nearest(df, df).collect())
    assert got[:3] == [(0, 1, 50), (0, 2, 1), (0, 3, 2)]
    assert {g[0] for g in got} == {0, 1, 2, 50} and all(g[2] in (0, 1, 2, 50) for g in got)


def test_no_rows(spark):
    df = frame(spark, [])
    assert kt.nearest(df, df).count() == 0
    one = frame(spark, [(0, [1.0, 2.0], 0, 0)])
    assert kt.nearest(one, one).count() == 0


def test_best_bin_first_reaches_every_leaf():
    rng = np.random.default_rng(0)
    x = kt.unit(rng.normal(size=(2000, 8)))
    tree = kt.Tree.fit(x, 60)
    n = len(tree.leaf)
    assert sorted(tree.order(x[0])) == list(range(n)) and n > 30
    assert set(tree.place(x)) <= set(range(n))
    assert len(kt.Tree.fit(np.ones((50, 3)) / np.sqrt(3), 10).leaf) == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall_on_the_table(spark, sf):
    got = {}
    for r in kt.op3_kmeans_tree(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = data["vec_id"].to_numpy(), np.array(data["embedding"].tolist(), np.float64)
    want = {int(ids[q]): {w[0] for w in truth(ids, x, q)} for q in np.flatnonzero(ids % 50 == 0)}
    assert sum(len(want[q] & got[q]) for q in want) >= 0.9 * sum(map(len, want.values()))
