import random

import corpus_pipeline as cp
import numpy as np
from llm_cases import frame

from corpusloom.llm import near_copies as nc
from corpusloom.llm.common import table, written


def grams(text, words=5):
    parts = (text or "").encode().lower().split()
    return frozenset(b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def brute(pairs, similarity=0.8):
    """The least id of each group: all pairs of 5-word Jaccard 0.8 or more."""
    sets, root = [grams(t) for _, t in pairs], list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(pairs):
        least[find(n)] = min(least.get(find(n), i), i)
    return set(least.values())


def made():
    rng, out = random.Random(5), []
    for k in range(40):  # chains of copies with single words changed, and texts between 0.5 and 0.9
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200, 500]))]
        for c in range(4):
            copy = list(words)
            for _ in range(c * len(words) // 70):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            out.append((k * 10 + c, " ".join(copy)))
    return out


def docs_of(spark, data):
    return spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_as_brute_force(spark):
    data = made()
    want = brute(data)
    got = {r["doc_id"] for r in cp.drop_near_copies(spark, docs_of(spark, data), "").collect()}
    assert got == want and len(want) < len(data) - 20


def test_stage_as_brute_force_on_the_table(spark, sf):
    docs = table(spark, sf, "documents").select(*cp.COLUMNS)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, docs, sf).collect()} == brute(data)


def test_a_dense_group_and_its_stragglers(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    data = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(300)] = f"y{i}"
        data.append((i, " ".join(copy)))
    assert {r["doc_id"] for r in cp.drop_near_copies(spark, docs_of(spark, data), "").collect()} == brute(data)


def test_partners_within_the_radius_meet():
    rng = np.random.default_rng(1)
    for _ in range(500):
        k = int(rng.integers(0, nc.RADIUS + 1))
        both = np.concatenate([rng.permutation(60)[:k], 64 + rng.permutation(60)[: nc.RADIUS - k]])
        x = [int(v) for v in rng.integers(0, 2**64, 2, dtype=np.uint64)]
        y = list(x)
        for b in both.tolist():
            y[b // 64] ^= 1 << b % 64
        n = int(rng.integers(5, 3000))
        key, place, own = nc.dealt(*[np.array(v, np.uint64) for v in zip(x, y)], np.array([n, int(np.ceil(0.8 * n))]))
        assert set(key[place == 1]) & set(key[(place == 0) & own])


def test_edges(spark):
    assert nc.near_copies(frame(spark).limit(0)).count() == 0
    found = nc.near_copies(frame(spark)).collect()
    assert len({r["node"] for r in found}) == len(found)


def test_odd_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for n, change in ((1, 0), (5, 1), (146, 16), (146, 50), (900, 100), (900, 900)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**64, change, dtype=np.uint64)]))
        apart = int(np.bitwise_count(nc.odd_sketch(a) ^ nc.odd_sketch(b)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert not nc.similar(a, b) or apart <= nc.ALLOWED * (len(a) + len(b)) + 1e-9
    a, b = (np.unique(rng.integers(0, 2**64, 146, dtype=np.uint64)) for _ in range(2))
    assert np.bitwise_count(nc.odd_sketch(a) ^ nc.odd_sketch(b)).sum() > nc.ALLOWED * 292  # unlike sets are told apart
    assert not nc.odd_sketch(np.zeros(0, np.uint64)).any()


def test_loads_differ_by_no_more_than_sets():
    rng = np.random.default_rng(4)
    asbytes = lambda a: np.frombuffer(nc.load(a), np.uint8)
    assert nc.alike(asbytes(np.zeros(0, np.uint64)), asbytes(np.zeros(0, np.uint64)))
    for n in (1, 3, 7, 8, 40, 511, 512, 5000, 20_000):  # of n or n + 1 and of changed shingles, similar or just so
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for change in (0, 1, n // 20, n // 9, n // 5):
            more = rng.integers(0, 2**64, change, dtype=np.uint64)
            for b in (np.unique(np.concatenate([a[change:], more])), np.unique(np.concatenate([a, more])), a[change:]):
                assert nc.alike(asbytes(a), asbytes(b)) or not nc.similar(a, b)
    full = np.arange(2000, dtype=np.uint64)  # more than 255 in one bucket
    assert nc.alike(asbytes(full), asbytes(full[:1900])) and nc.similar(full, full[:1900])
    for n in (200, 600, 5000, 20_000):  # unlike sets of any size are told apart, where odd sketches pass them
        a, b = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2))
        assert not nc.alike(asbytes(a), asbytes(b))


def test_sets_are_made_of_likely_pairs_alone(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [words(n) for n in (900, 900, 1000)]
    texts.append(texts[2] + " end")
    docs = docs_of(spark, list(enumerate(texts)))
    nodes = [r[0] for r in docs.orderBy("doc_id").select(nc._node()).collect()]
    prints = nc._prints(docs.select(nc._node().alias("node"), "text"))
    pairs = written(spark.createDataFrame([(nodes[0], nodes[1]), (nodes[0], nodes[2]), (nodes[2], nodes[3])], "a long, b long"), "test-pairs")
    assert [tuple(r) for r in nc.likely(prints, pairs).collect()] == [(nodes[2], nodes[3])]
    assert [tuple(r) for r in nc.verified(docs, prints, pairs).collect()] == [(nodes[2], nodes[3])]


def test_texts_that_few_pairs_need_are_not_shuffled(spark):
    """Beyond the width of what is dealt, no exchange carries texts: neither those for sets nor those that stay."""
    data = [(i, f"only {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    data += [(100 + i, t) for i, t in data[:4]] + [(200 + i, t + " end") for i, t in data[:4]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.drop_near_copies(spark, docs_of(spark, data), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["doc_id"] for r in out.collect()} == brute(data) == set(range(30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_search_by_blocks_is_that_of_all_blocks(spark):
    assert sorted(b for own in nc.WIDE for b in own) == list(range(nc.BLOCKS))
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, (40, 2))
    rows = []
    for i, (x, y) in enumerate(base.tolist()):
        for c in range(3):
            flip = lambda v: int((np.array(v) ^ np.bitwise_or.reduce(np.left_shift(1, rng.integers(0, 60, 5 * c)), initial=0)))  # noqa: B023, E731
            rows.append((3 * i + c, flip(x), flip(y), 0, 0, 100, 3 * i + c))
    nodes = spark.createDataFrame(rows, "node long, fp long, fp2 long, odd long, odd2 long, n int, root long")
    pairs = lambda blocks: {tuple(r) for r in nc.candidates(nodes, blocks).collect()}
    parts = [pairs(b) for b in nc.WIDE]
    assert set().union(*parts) == pairs(tuple(range(nc.BLOCKS))) and len(set().union(*parts)) >= 40
