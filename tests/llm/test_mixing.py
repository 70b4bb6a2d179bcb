import numpy as np
import pyarrow as pa
import pytest
from llm_cases import empty, frame, rows

from corpusloom.llm import mixing as mx


def test_raking_reaches_the_marginals():
    rng = np.random.default_rng(2)
    a, b = (x.ravel() for x in np.meshgrid(range(4), range(5), indexing="ij"))
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.full(5, 0.2)]
    w = mx.rake(rng.random(20) + 0.1, [a, b], goals)
    assert np.allclose(np.bincount(a, w), goals[0]) and np.allclose(np.bincount(b, w), goals[1])


def test_probabilities_keep_the_budget():
    p = mx.probabilities(np.array([0.5, 0.3, 0.2]), np.array([10.0, 100.0, 1000.0]), 300)
    assert p.max() <= 1 and abs((p * [10, 100, 1000]).sum() - 300) < 1e-6 and p[0] == 1


def test_the_table_gets_its_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mx.mixed(df, targets={"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}, fraction=0.3).toPandas()
    assert len(got) == 1000
    mass = got["tokens"] * got["weight"]
    share = mass.groupby(got["lang"]).sum() / mass.sum()
    assert np.allclose([share["en"], share["fr"], share["de"], share["es"]], [0.4, 0.3, 0.2, 0.1], atol=1e-6)
    assert abs((got["tokens"] * got["probability"]).sum() / got["tokens"].sum() - 0.3) < 1e-6
    assert abs(got.loc[got["sampled"], "tokens"].sum() / got["tokens"].sum() - 0.3) < 0.08


def brute(got, targets, temper, fraction):
    """weight and probability by cell: plain loops over the cells of a result's documents."""
    cells, total = {}, 0
    for r in got:
        cells[(r["source"], r["lang"], r["topic"])] = cells.get((r["source"], r["lang"], r["topic"]), 0) + r["tokens"]
        total += r["tokens"]
    cells = {k: n for k, n in cells.items() if n}
    goals = []
    for d, name in enumerate(mx.DIMENSIONS):
        have = {}
        for k, n in cells.items():
            have[k[d]] = have.get(k[d], 0) + n
        raw = {v: targets[name].get(v, 0.0) if name in targets else (n / total) ** temper for v, n in have.items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    share = {k: n / total for k, n in cells.items()}
    for _ in range(mx.ROUNDS):
        for d, goal in enumerate(goals):
            have = {}
            for k, x in share.items():
                have[k[d]] = have.get(k[d], 0.0) + x
            share = {k: x * goal[k[d]] / have[k[d]] if have[k[d]] else 0.0 for k, x in share.items()}
    most = sum(n for k, n in cells.items() if share[k])
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(n * min(1, mid * share[k] / n) for k, n in cells.items()) < min(fraction * total, most):
            low = mid
        else:
            high = mid
    return {k: (share[k] / (n / total), min(1, high * share[k] / n)) for k, n in cells.items()}


def dense(spark):
    """Every source has every language; a source and a language are null, and one source is called as a sign that could stand for null."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{j % 9}x{rng.integers(40)}" for _ in range(int(rng.integers(1, 30)))), ["en", "fr", None][k % 3], ["s", "t", None, "\x00"][k // 3 % 4]) for k, j in enumerate(rng.integers(0, 9, 400))]
    return spark.createDataFrame([*rows, (1000, None, "xx", "s"), (1001, "", "en", "s")], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 0.7, None: 0.3, "absent": 5.0}}, {"source": {"t": 1.0, None: 1.0, "\x00": 2.0}, "lang": {"fr": 1.0}}])
def test_both_paths_as_brute_force(spark, targets):
    df = dense(spark)
    one = {r["doc_id"]: r for r in mx.mixed(df, targets=targets, fraction=0.2).collect()}
    other = {r["doc_id"]: r for r in mx.mixed(df, targets=targets, fraction=0.2, max_cells=0).collect()}
    want = brute(one.values(), targets, mx.TEMPER, 0.2)
    assert len(one) == len(other) == 402
    for d, r in one.items():
        weight, chance = want.get((r["source"], r["lang"], r["topic"]), (1.0, 1.0))
        for x in (r, other[d]):
            assert abs(x["weight"] - weight) < 1e-5 and abs(x["probability"] - chance) < 1e-5
        assert r["sampled"] == other[d]["sampled"]
    if "lang" in targets:
        gone = {r["doc_id"] for r in one.values() if r["lang"] not in targets["lang"] and r["tokens"]}
        assert gone and not any(one[d]["sampled"] for d in gone)


@pytest.mark.parametrize("fraction", [0.5, 1.0])
def test_edges(spark, fraction):
    got = mx.mixed(frame(spark), carry=("text",), fraction=fraction).collect()
    assert len(got) == len(rows())
    assert all(0 <= r["probability"] <= 1 for r in got)
    assert {r["topic"] for r in got if not (r["text"] or "").split()} == {-1}
    same = {}
    for r in got:
        same.setdefault((r["doc_id"], r["text"], r["lang"], r["source"]), set()).add((r["probability"], r["sampled"]))
    assert all(len(v) == 1 for v in same.values())
    assert mx.mixed(empty(spark)).count() == 0


def test_topics_come_from_all_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mx.vectors(df).cache()
    x = np.unique(mx.hashed(pa.array([t for (t,) in df.where("text is not null").select("text").collect() if t.split()]))[0].astype(float), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = mx.topic_centres(rows, rounds=40)
    at = (x @ centres.T).argmax(axis=1)
    for k in set(at.tolist()):  # the centres are those of their members, of all documents
        own = x[at == k].sum(axis=0)
        assert own @ centres[k] > 0.999 * np.linalg.norm(own)
    again = mx.topic_centres(rows.unionByName(rows.limit(300)).unionByName(rows.limit(300)), rounds=40)  # copies count once
    assert np.array_equal(centres, again)
