import numpy as np
import pytest
import xxhash
from llm_cases import empty, frame, rows, simple

from corpusloom.llm import simhash as sh
from corpusloom.llm.components import components


def naive(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(pairs, bits=3):
    n = len(pairs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(n)]


def test_as_brute_force(spark):
    data = [(r[0], r[1]) for r in rows()]
    base = " ".join(f"w{i}" for i in range(400))
    data += [(7000 + i, base.replace(f"w{i * 7} ", f"x{i} ")) for i in range(25)]
    want = [(d, naive(t)) for d, t in data]
    comp = groups(want)
    got = sh.near_duplicates(simple(spark, data)).collect()
    assert sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got], key=str) == sorted([(d, f, c) for (d, f), c in zip(want, comp)], key=str)


def test_extra_columns_and_no_rows(spark):
    assert sh.near_duplicates(frame(spark), carry=("lang",)).columns == ["doc_id", "lang", "fp", "component_id"]
    assert sh.near_duplicates(empty(spark)).count() == 0


def test_partners_meet_at_a_home():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        key, place, home = sh.anchors(np.array([x, y], np.uint64))
        assert set(key[(place == 0) & home]) & set(key[place == 1])


def test_links_are_complete_with_hot_anchors(spark):
    rng = np.random.default_rng(2)
    fps = {int(rng.integers(0, 2**63))}
    while len(fps) < 400:  # a dense ball, chains of near ones, and far ones
        x = int(rng.choice(np.array(list(fps), np.uint64)))
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x if rng.random() < 0.9 else int(rng.integers(0, 2**63)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    want = groups([(i, f) for i, f in enumerate(fps)])
    for hot in (20_000, 5):
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(sh.links(df, hot_rows=hot)).collect()}
        label = {}
        for f, w in zip(fps, want):
            label.setdefault(w, set()).add(got.get(f, f))
        assert all(len(v) == 1 for v in label.values()) and len(set().union(*label.values())) == len(label)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_chains_hubs_and_pairs(spark, few):
    from corpusloom.llm.components import components

    rng = np.random.default_rng(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 640)] + [(-3, 9), (9, -3), (7, 7), (None, 4)] + [tuple(x) for x in rng.integers(1000, 1100, (60, 2)).tolist()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(root))
    got = components(spark.createDataFrame(links, "a long, b long"), few=few)
    assert sorted((r["node"], r["root"]) for r in got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0
