import hashlib
import random

import numpy as np
import pytest
from llm_cases import empty, frame, rows, simple
from pyspark import TaskContext

from corpusloom.llm import winnowing as wn


def gram_hash(g):
    x = 0
    for c in g:
        x = (x * wn._BASE + ord(c) + 1) % 2**64
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) % 2**64
    return x >> 32


def brute(t, k, w):
    if not t:
        return [], []
    k = min(k, len(t))
    h = [gram_hash(t[i : i + k]) for i in range(len(t) - k + 1)]
    w = min(w, len(h))
    found = {}
    for s in range(len(h) - w + 1):
        least = min(h[s : s + w])
        found[s + max(i for i, x in enumerate(h[s : s + w]) if x == least)] = least
    return [found[p] for p in sorted(found)], sorted(found)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_as_brute_force(monkeypatch, block):
    monkeypatch.setattr(wn, "BLOCK", block)
    rng = random.Random(4)
    for k, w in ((16, 32), (5, 7), (13, 1), (1, 3)):
        for n in (0, 1, 3, 15, 16, 17, 47, 48, 100, 400):
            t = "".join(rng.choice("abé😀") for _ in range(n))
            h, p = wn.winnow(t, k, w)
            assert (h.tolist(), p.tolist()) == brute(t, k, w)
            again = wn.read_in(wn.written_out(h, p))
            assert again[0].tolist() == h.tolist() and again[1].tolist() == p.tolist()


def test_shared_passages_are_found():
    rng = random.Random(5)
    for _ in range(100):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(wn.match_guarantee()))
        a, b = ("".join(rng.choice("ABCDEFGH ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        assert set(wn.winnow(a + shared + b)[0]) & set(wn.winnow(b + shared + a)[0])


def expected(data):
    order = sorted(data, key=lambda r: (wn.NULL_ID if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    out = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        sets = [set(wn.winnow(t)[0].tolist()) for t in (text, new, after)]
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), wn.written_out(*wn.winnow(text)), wn.written_out(*wn.winnow(new)), wn.likeness(sets[0], sets[1]), wn.likeness(sets[0], sets[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("bytes_", [100, 5_000, 8 << 20])
def test_beside_the_next(spark, bytes_):
    data = [(r[0], r[1]) for r in rows()]
    got = [tuple(r) for r in wn.edit_stability(simple(spark, data), bucket_bytes=bytes_).collect()]
    assert sorted(got, key=str) == expected(data)


def test_one_row_no_rows_and_extra_columns(spark):
    assert [r["near_next"] for r in wn.edit_stability(simple(spark, [(5, "alone here")])).collect()] == [1.0]
    assert wn.edit_stability(empty(spark)).count() == 0
    assert wn.edit_stability(frame(spark)).count() == len(rows())
    prints = wn.fingerprints(frame(spark)).collect()
    assert len(prints) == len(rows()) and all(len(r["hashes"]) == len(r["positions"]) for r in prints)
    assert np.isfinite(len(prints))


def test_many_rows_without_ids_are_dealt_by_their_texts(spark):
    data = [(None if i % 3 else i, f"text {i % 400} " + "abc " * (i % 7)) for i in range(600)] + [(7, f"seven {i}") for i in range(150)]
    seen = []
    for most in (5, 64):
        own = simple(spark, data)
        made = wn.beside_next(own, "part long, text string, following string", lambda: (lambda t: None, lambda t, _, after, __: (TaskContext.get().partitionId(), t, after)), 100, most).collect()
        seen.append(len({r["part"] for r in made if r["doc_id"] is None}))
        order = sorted(data, key=lambda r: (-(2**63) if r[0] is None else r[0], hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
        want = [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1])]
        assert sorted(((r["doc_id"], r["text"], r["following"]) for r in made), key=str) == sorted(want, key=str)
    assert seen[0] > 1 and seen[1] > 8
    bounds, shares = np.array([-5, 3]), np.array([1, 4])
    at = wn._range_of(bounds, shares, np.array([-9, -5, 2, 3, 3, 3, 8]), ["0" * 32, "f" * 32, "f" * 32, "0" * 32, "8" + "0" * 31, "f" * 32, "0" * 32])
    assert at.tolist() == [0, 0, 1, 1, 3, 4, 5]
